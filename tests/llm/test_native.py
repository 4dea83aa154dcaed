"""Exact dedup, chat formatting and packing: SQL, brute force, and odd inputs."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, exact_dedup, packing
from quillon.llm import queries as Q

from .. import oracle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest string"


def docs(spark, *rows):
    """Rows of (doc_id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.check(Q.queries()[name](spark, SF), oracle.connect(SF).sql(Q.oracle_sql()[name]).df())


ODD = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (2, "aB"), (None, "ab"), (7, "z" * 200_000), (7, "other"), (8, "other"), (None, "no id"), (None, "No id")]


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_odd_rows(spark, batches):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs(spark, *ODD), batches=batches).collect()}
    assert got == {
        (1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True),
        (7, 8, 2, False), (8, 8, 2, True), (None, None, 2, True),
    }


@pytest.mark.parametrize("batches", [1, 2])
def test_survivors_are_one_row_for_each_text(spark, batches):
    got = exact_dedup.survivors(docs(spark, *ODD).withColumn("_digest", F.lit("clash")).withColumn("_keep_id", F.lit(1)), batches=batches)
    assert got.columns == [*docs(spark).columns, "_digest", "_keep_id"]
    low = sorted((str(r.doc_id), (r.text or "").lower()[:9]) for r in got.collect())
    assert low == sorted([("2", "ab"), ("4", ""), ("5", "é"), ("6", "é"), ("7", "zzzzzzzzz"), ("8", "other"), ("None", "no id")])


def test_a_repeated_id_loses_no_other_text(spark):
    got = exact_dedup.survivors(docs(spark, (4, "x"), (4, "y"), (9, "x"), (None, "x"), (9, "x"))).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(4, "y"), (9, "x")]


def test_exact_empty_table(spark):
    for batches in (1, 2):
        assert exact_dedup.dedup(docs(spark, (1, "a")).where("false"), batches=batches).count() == 0
        assert exact_dedup.survivors(docs(spark, (1, "a")).where("false"), batches=batches).count() == 0


def kept(df):
    return {r.doc_id: (r.keep_id, r.kept) for r in df.collect()}


def test_index_persists_and_survives_retries(spark):
    first, second = docs(spark, (1, "a"), (2, "b")), docs(spark, (3, "A"), (4, "c"), (5, "c"))
    ask = lambda d, b: kept(exact_dedup.dedup(d, table="digests_of_test", batch=b))
    exact_dedup.DigestIndex(spark, "digests_of_test", 3)
    want = {1: (1, True), 2: (2, True)}
    assert ask(first, "one") == want
    index = exact_dedup.DigestIndex(spark, "digests_of_test")
    assert index.buckets == 3
    assert ask(first, "one") == want  # a retry keeps its rows
    later = {3: (1, False), 4: (5, False), 5: (5, True)}
    assert ask(second, "two") == later and ask(second, "two") == later
    assert ask(first, "three") == {1: (1, False), 2: (2, False)}
    assert index.rows().count() == 3
    # an attempt that got half its texts in
    half = exact_dedup.digest(F.col("text")).alias("digest")
    index.add(docs(spark, (6, "d")).select(F.col("doc_id").alias("id"), half), "four/0")
    assert ask(docs(spark, (6, "d"), (7, "e")), "four") == {6: (6, True), 7: (7, True)}
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("digests_of_test", "quillon_digests"))]


def test_second_batch_meets_the_first(spark):
    rows = docs(spark, *[(i, f"t{i % 5}") for i in range(40)]).select(F.col("doc_id").alias("id"), exact_dedup.digest(F.col("text")).alias("digest"))
    index = exact_dedup.DigestIndex(spark, "digests_of_parts")
    high, low = exact_dedup._batches(rows, 2)
    assert index.add(high, "b/0").where("fresh").count() == 5
    second = index.add(low, "b/1")
    assert second.where("fresh").count() == 0 and {r.keep_id for r in second.collect()} == {35, 36, 37, 38, 39}
    index.drop()


def turns(spark, *rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute_maximal(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is None, t or 0, r is not None, r or "", x is not None, x or ""))
    conv = {c: tuple(x[2:] for x in sorted(v)) for c, v in conv.items()}
    keep = {c for c, v in conv.items() if not any(len(w) > len(v) and w[: len(v)] == v for w in conv.values())}
    return {c for c in keep if not any(d < c and conv[d] == conv[c] for d in keep)}


def test_chat_snapshots(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 5, "user", None),
        (4, 0, "user", "a"), (4, 1, "bot", "b"), (4, 5, "user", ""), (5, 0, None, "q"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "a"), (7, None, "user", "z"),
        (8, 0, "user", "a"), (8, 1, "bot", "b"), (8, 5, "user", None),
    ]
    got = chat.format_chats(turns(spark, *rows).withColumn("k", F.lit(1)).withColumn("h1", F.lit("clash"))).collect()
    assert {r.conv_id for r in got} == brute_maximal(rows)
    assert {r.conv_id: r.n_copies for r in got}[3] == 2
    assert {r.conv_id: r.rendered for r in got}[3] == "<|user|>\na\n<|bot|>\nb\n<|user|>\n\n"
    assert chat.format_chats(turns(spark, *rows).where("false")).count() == 0


def test_chat_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "a\x00vb", "c"), (2, 0, "a", "b\x00vc"), (2, 1, "bot", "x" * 300_000), (3, 0, "r", None), (4, 0, "r", ""), (3, 1, "r", "q"), (3, 1, "r", "q")]
    got = {r.conv_id: r.n_turns for r in chat.format_chats(turns(spark, *rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_a_conversation_of_very_many_turns(spark, monkeypatch):
    from quillon.operators import scans

    rows = [(1, k // 3, "user", f"t{k % 5}") for k in range(400)] + [(2, k // 3, "user", f"t{k % 5}") for k in range(250)] + [(3, None, None, "x"), (3, 0, "a", "y"), (3, None, None, "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = sorted(map(tuple, chat.format_chats(t).collect()))
    assert [(r[0], r[1]) for r in want] in ([(1, 400), (3, 3)], [(1, 400), (2, 250), (3, 3)])
    monkeypatch.setattr(scans, "HOT_ROWS", 50)
    assert sorted(map(tuple, chat.format_chats(t).collect())) == want


def brute_pack(lengths, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] > 0 and b["room"] >= n and s not in b["s"] and c not in b["c"]]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_pack_equals_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(0, 60)
        lengths = sorted((rng.choice([0, 0, rng.randint(1, 50)]) for _ in range(n)), reverse=True)
        s, c = [rng.choice([0, 0, 0, rng.randint(1, 9)]) for _ in range(n)], [rng.randint(0, 20) for _ in range(n)]
        assert packing.pack(lengths, s, c, 50) == brute_pack(lengths, s, c, 50)


def test_common_keys_pack_the_same(monkeypatch):
    rng = random.Random(12)
    for common in (0, 3, 64):
        monkeypatch.setattr(packing, "COMMON", common)
        for _ in range(60):
            n = rng.randint(0, 120)
            lengths = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True)
            s, c = [rng.choice([0, 0, 0, 1, 2, rng.randint(3, 9)]) for _ in range(n)], [rng.choice([0, 0, rng.randint(1, 40)]) for _ in range(n)]
            assert packing.pack(lengths, s, c, 50) == brute_pack(lengths, s, c, 50)


def test_one_source_in_every_row_takes_little_time():
    n = packing.SHARD_ROWS * 2
    start = time.time()
    assert packing.pack([1] * n, [0] * n, [0] * n, 2048) == list(range(n))
    assert packing.pack([1] * n, [0] * n, list(range(n)), 2048) == list(range(n))
    assert time.time() - start < 10


def test_rows_without_or_with_one_id_fill_all_shards(spark):
    for own in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        d = spark.range(60_000).repartition(6).select(own.alias("doc_id"), F.lit("some text").alias("text"), F.lit("s").alias("source"))
        start = time.time()
        got = packing.pack_documents(d)
        sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
        assert sum(sizes) == 60_000 and len(sizes) == 15 and max(sizes) < 1.2 * 60_000 / 15
        assert time.time() - start < 60


def test_packing_holds_constraints_and_whole_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(d, capacity=512, shard_rows=64).toPandas()
    info = d.select("doc_id", F.xxhash64("source").alias("s"), F.lower("text").alias("t"), packing.words(F.col("text")).alias("n")).toPandas().set_index("doc_id")
    assert got.groupby("doc_id").length.sum().to_dict() == info.n.to_dict()
    got["s"], got["t"] = got.doc_id.map(info.s), got.doc_id.map(info.t)
    for _, b in got.groupby(["shard", "bin"]):
        assert b.length.sum() <= 512 and b.s.is_unique and b.t.is_unique
    assert got.groupby("doc_id").apply(lambda x: (x.sort_values("start").start.diff().dropna() == 512).all(), include_groups=False).all()


def test_packing_of_shards_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(d, capacity=300, shard_rows=64).collect()
    info = {r.doc_id: r for r in d.select("doc_id", F.xxhash64("source").alias("s"), F.xxhash64(F.lower(F.coalesce("text", F.lit("")))).alias("c"), packing.words(F.col("text")).alias("n")).collect()}
    shards = defaultdict(dict)
    for r in got:
        shards[r.shard][(r.doc_id, r.start)] = r.bin
    assert len(shards) > 2
    for own in shards.values():
        ids = sorted({i for i, _ in own})
        made = [(i, a, min(300, info[i].n - a)) for i in ids for a in range(0, max(1, info[i].n), 300)]
        made.sort(key=lambda p: (-p[2], p[0], p[1]))
        bins = brute_pack([n for _, _, n in made], [info[i].s for i, _, _ in made], [info[i].c for i, _, _ in made], 300)
        assert {(i, a): b for (i, a, _), b in zip(made, bins, strict=True)} == own


def test_packing_odd_rows(spark):
    d = docs(spark, (1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "c"), (5, "w " * 5000))
    got = packing.pack_documents(d, source=F.col("doc_id")).collect()
    assert sum(r.length for r in got) == 2 + 2 + 1 + 5000
    assert packing.pack_documents(d.where("false")).count() == 0


def test_packing_of_a_very_long_text(spark):
    d = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x y", "b"), (3, None, None)], "doc_id long, text string, source string")
    got = packing.pack_documents(d).collect()
    own = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert sum(n for _, n in own) == 300_000 and [a for a, _ in own] == list(range(0, 300_000, packing.CAPACITY)) and {r.doc_id for r in got} == {1, 2, 3}
