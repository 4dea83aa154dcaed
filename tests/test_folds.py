"""Greedy folds and block searches against plain loops; what reaches a shuffle is bounded."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, folds


def rows(spark, seed=1, n=900):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        t = rng.choice([rng.uniform(-50, 400), float(rng.randint(0, 40))])
        data.append((i, rng.choice([None, 1, 1, 1, 2]), t, t + rng.choice([0.0, 3.0, 20.0]), rng.choice("abc"), rng.random() < 0.3, f"payload {i}"))
    return spark.createDataFrame(data, "id long, k long, s double, e double, kind string, peak boolean, payload string").repartition(3)


def by_key(df, order):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=order):
        out[r.k].append(r)
    return out


def loop(groups, rule, needs, fill=0):
    """The same, over lists."""
    want = []
    for g in groups.values():
        own, taken, left, over = rule(), [], [], False
        for r in g:
            if over:
                continue
            took = own(*(r[c] for c in needs))
            over = took is None
            if took:
                taken.append(r)
            elif not over:
                left.append(r)
        if taken and own.drops_last():
            taken.pop()
        want += [(r.id, r.payload, p) for p, r in enumerate([*taken, *left[: max(0, fill - len(taken))]], 1)]
    return sorted(want)


CASES = [
    (["s"], lambda: folds.Apart(30.0, 4), 4), (["s"], lambda: folds.Apart(10_000.0, 4), 3), (["s", "e"], lambda: folds.EdgesApart(15.0, 5), 0), (["s", "s", "e"], lambda: folds.Another(10.0), 0),
    (["kind", "s", "e"], lambda: folds.Budget(120.0, {"a": 2, "b": 9}, 30), 0), (["peak"], lambda: folds.Cuts(4), 0), (["s", "e"], lambda: folds.Segments(200.0, 25.0), 0), (["s"], lambda: folds.After(12.5), 0), (["s"], lambda: folds.After(12.5, True), 0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("batch", [7, 10_000])
def test_walks_equal_loops(spark, case, batch):
    needs, rule, fill = CASES[case]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = rows(spark)
        got = folds.walked(df, ["k"], ["s", "id"], needs, rule, fill).select("id", "payload", "pick").collect()
        assert sorted(map(tuple, got)) == loop(by_key(df, lambda r: (r.s, r.id)), rule, needs, fill)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert folds.walked(df.where("false"), ["k"], ["s", "id"], needs, rule, fill).count() == 0


def test_rules_hold():
    """What each rule promises, by definition and not by its own steps."""
    rng = random.Random(4)
    for _ in range(200):
        spans = sorted((a := rng.uniform(0, 300), a + rng.uniform(0, 30)) for _ in range(rng.randint(1, 30)))
        rng.shuffle(spans)
        budget, taken = folds.Budget(60.0, {}, 99), []
        for s, e in spans:
            cells = lambda xs: union(xs)
            ok = cells([*taken, (s, e)]) <= 60.0
            assert budget("x", s, e) == ok
            taken += [(s, e)] * ok
        apart = folds.EdgesApart(5.0, 99)
        kept = [x for x in spans if apart(*x)]
        assert all(max(b[0] - a[1], a[0] - b[1]) >= 5.0 for i, a in enumerate(kept) for b in kept[:i])


def union(spans):
    total, end = 0.0, float("-inf")
    for s, e in sorted(spans):
        total, end = total + max(0.0, e - max(s, end)), max(end, e)
    return total


def test_a_large_key_takes_little_memory(spark):
    df = spark.range(1_500_000).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("t"), "id")
    got = folds.walked(df, ["k"], ["t", "id"], ["t"], lambda: folds.After(100_000.0))
    assert [r.id for r in got.orderBy("pick").collect()] == list(range(0, 1_500_000, 100_000))


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).round(2)
    v[n // 2 : n // 2 + 5] = v[0]
    v[3] = 0
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("measure", blocks.MEASURES)
@pytest.mark.parametrize("size", [16 << 20, 700])
def test_top_rows_equal_brute_force(spark, monkeypatch, measure, size):
    monkeypatch.setattr(blocks, "QUERY_BYTES", size)
    monkeypatch.setattr(blocks, "ROWS", 11)
    monkeypatch.setattr(blocks, "WAITING", 50)
    v = vectors(2, 230)
    q = v[:9] + [(50, v[50][1])]
    odd = [(900, None), (901, [1.0]), (902, [None] + v[0][1][1:]), (3, v[3][1])]
    x = spark.createDataFrame(v + odd, "vec_id long, vec array<double>").repartition(5)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in blocks.top_rows(spark.createDataFrame(q, "query_id long, vec array<double>"), x, 7, measure).collect()}
    want = {}
    for i, a in q:
        s = []
        for j, b in v:
            d = sum(p * r for p, r in zip(a, b, strict=True))
            n = (sum(p * p for p in a) ** 0.5 or 1.0) * (sum(p * p for p in b) ** 0.5 or 1.0)
            s.append((-round(d if measure == "dot" else d / n, 6), j))
        want |= {(i, k): (j, -m) for k, (m, j) in enumerate(sorted(s)[:7], 1)}
    assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    few = blocks.top_rows(spark.createDataFrame(q, "query_id long, vec array<double>"), x.where("vec_id < 3"), 7, measure)
    assert few.count() == 30 and blocks.top_rows(spark.createDataFrame(q, "query_id long, vec array<double>").where("false"), x, 3).count() == 0


def test_a_task_sends_on_its_best_rows_only(spark):
    x = spark.createDataFrame(vectors(3, 2000), "vec_id long, vec array<double>").repartition(6)
    q = x.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    found = blocks.top_rows(q, x, 4)
    sent = found._jdf.queryExecution().optimizedPlan().collectLeaves()  # the plan has one scan of the rows and no join
    assert sent.size() == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    best = blocks.Best(3, 4)
    for k in range(50):
        best.add(np.random.default_rng(k).random((3, 100)), np.arange(100) + 100 * k)
    assert len(best.choose()[0]) == 12


@pytest.mark.parametrize("queries, cells, terms", [(256, 4_000_000, 1_000_000), (2, 40, 1_000_000), (256, 4_000_000, 5)])
def test_bm25_blocks_equal_postings(spark, monkeypatch, queries, cells, terms):
    from quillon.functions import text as T
    from quillon.operators import ranking

    monkeypatch.setattr(blocks, "QUERIES", queries)
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "TERMS", terms)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    d = spark.createDataFrame([(i, text(rng.randint(0, 30))) for i in range(150)] + [(150, None), (151, ""), (152, "w1 w1"), (153, "w1 w1")], "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(i, text(rng.randint(1, 6))) for i in range(7)] + [(7, "unknown"), (8, ""), (9, "w1")], "query_id long, text string")
    got = ranking.top_bm25(d, q, 9).collect()
    scored = ranking.bm25(d, q).withColumn("score", F.round("score", 6))
    want = ranking.top_k(scored, ["query_id"], 9, F.desc("score"), F.col("doc_id")).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got) == sorted((r.query_id, r.rank, r.doc_id) for r in want) and len(got) == 9 * 8
    assert all(abs(a.score - b.score) < 2e-6 for a, b in zip(sorted(got, key=lambda r: (r.query_id, r.rank)), sorted(want, key=lambda r: (r.query_id, r.rank)), strict=True))
    assert ranking.top_bm25(d.where("false"), q, 9, T.tokens).count() == ranking.top_bm25(d, q.where("false"), 9).count() == 0


def weighted_case(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    odd = [(150, None, vec()), (151, "", None), (152, "w1 w1", [0.0] * 4), (153, "w1", [1.0, 2.0]), (154, "w2", [1.0, None, 0.0, 2.0]), (155, "w1 w1", [])]
    d = spark.createDataFrame([(i, text(rng.randint(0, 20)), vec()) for i in range(150)] + odd, "doc_id long, text string, vec array<float>")
    q = [(i, text(rng.randint(1, 6)), vec()) for i in range(6)] + [(6, "unknown", vec()), (7, "", vec()), (8, "w1 w2", None), (9, None, None), (10, "w3", [0.0] * 4), (11, "w4", [1.0, None, 1.0, 1.0])]
    return d.repartition(4), q, "query_id long, text string, vec array<float>"


def same_as_pairs(spark, d, q):
    from quillon.operators import ranking

    got = ranking.top_weighted(d, q, 9, 0.7, 0.3).collect()
    want = ranking.top_k(ranking.weighted_pairs(d, q, 0.7, 0.3).withColumn("score", F.round("score", 6)), ["query_id"], 9, F.desc("score"), F.col("doc_id")).collect()
    key = lambda r: (r.query_id, r.rank, r.doc_id)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(abs(a.score - b.score) < 2e-6 or a.score != a.score for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    return len(got)


@pytest.mark.parametrize("queries, cells", [(256, 4_000_000), (2, 40)])
def test_weighted_blocks_equal_pairs(spark, monkeypatch, queries, cells):
    monkeypatch.setattr(blocks, "QUERIES", queries)
    monkeypatch.setattr(blocks, "CELLS", cells)
    d, q, schema = weighted_case(spark)
    assert same_as_pairs(spark, d, spark.createDataFrame(q, schema)) == 9 * 12
    assert same_as_pairs(spark, d.where("doc_id < 5"), spark.createDataFrame(q, schema)) == 5 * 12
    assert same_as_pairs(spark, d.where("false"), spark.createDataFrame(q[:2], schema)) == same_as_pairs(spark, d, spark.createDataFrame([], schema)) == 0


def test_weighted_search_makes_no_pairs_but_for_odd_tables(spark, monkeypatch):
    from quillon.operators import ranking, registry

    d, q, schema = weighted_case(spark)
    few = spark.createDataFrame(q[:3], schema)
    for rows, asked in ((d.unionByName(d.where("doc_id = 3")), few), (d, spark.createDataFrame([*q[:2], (20, "w1", [1.0, 2.0])], schema)), (d, spark.createDataFrame([*q[:2], (20, "w1", [])], schema)), (d, few.unionByName(few.limit(1)))):
        assert blocks.top_weighted(rows, asked, 9, 0.7, 0.3, ranking.T.tokens) is None
    strange = d.unionByName(spark.createDataFrame([(200, "w1", [float("inf"), 1.0, 1.0, 1.0])], schema.replace("query_id", "doc_id")))
    assert blocks.top_weighted(strange, few, 9, 0.7, 0.3, ranking.T.tokens) is None
    monkeypatch.setattr(ranking, "fused", lambda *a: pytest.fail("pairs"))
    assert registry.retrieve(few, d, "weighted", 9).count() == 27
