"""The pipeline against a brute-force version of the stages that have one, and its contract."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from quillon.llm import secrets

from .test_texts import brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "secrets", "packing"]
    kept = []
    for name, stage in P.STAGES[:-1]:
        before = docs.toPandas()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        after = docs.toPandas()
        kept.append((name, before, after))
        docs = spark.createDataFrame(after, docs.schema)
    tox, exact, near, sec = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    gone = set(tox[1].doc_id) - set(tox[2].doc_id)
    clean = set(labels[labels == 0].index) & set(tox[1].doc_id)
    assert len(gone & clean) <= 0.03 * len(clean)
    low = {}
    for i, t in zip(exact[1].doc_id, exact[1].text, strict=True):
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        low[key] = max(low.get(key, -1), i)
    assert set(exact[2].doc_id) == set(low.values())
    rows = near[1].sort_values("doc_id")
    roots, pairs = brute_near(rows.text.tolist())
    ids = rows.doc_id.tolist()
    want = {i for k, i in enumerate(ids) if roots[k] == k}
    assert want <= set(near[2].doc_id) and len(set(near[2].doc_id) - want) <= max(1, 0.05 * len(pairs))
    assert set(sec[1].doc_id) == set(sec[2].doc_id)
    was, now = sec[1].set_index("doc_id"), sec[2].set_index("doc_id")
    for i in was.index:
        assert not secrets.base_spans(now.text[i])
        if secrets.base_spans(was.text[i]):
            assert now.n_chars[i] == len(now.text[i])
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, base string, redacted string, length long, id long, node string, digest string, _score int, fp string, key string, x string, keep_id int, cluster string"


def odd(spark, rows):
    wide = [(*r, 0.5, "s", "b", "r", 7, 1, "n", "d", 3, "f", "k", "x", 2, "c") for r in rows]
    return spark.createDataFrame(wide, NAMES)


ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (4, "A B C", None, "s", 5), (4, "A B C", None, "s", 5), (5, "w " * 20_000, "en", None, 1),
    (None, "n", "en", "s", 1), (4, "another text", "en", "s", 12), (None, "a b C", "en", "s", 5), (9, "token=abcdefghij x", "en", "s", 18), (9, "TOKEN=abcdefghij x", "en", "s", 18),
]


def test_stages_take_odd_rows_and_clashing_names(spark):
    d = odd(spark, ROWS)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        d = spark.createDataFrame(out.collect(), d.schema)
        assert stage(spark, d.where("false"), SF).count() == 0
    assert P.STAGES[-1][1](spark, d.where(F.lit(True)), SF).count() > 0
    assert P.STAGES[-1][1](spark, d.where("false"), SF).count() == 0
    # brute force: one row for each text (lower-cased), whatever ids are shared; redacted, every other text whole
    low = {}
    for i, t, *_ in ROWS:
        low.setdefault((t or "").lower(), []).append(i)
    got = sorted((r.text or "").lower() for r in d.collect())
    assert got == sorted("<secret> x" if "token" in t else t for t in low)


def test_stages_keep_other_texts_of_a_shared_id(spark):
    rows = [(4, "x", "en", "s", 1), (4, "y", "en", "s", 1), (9, "x", "en", "s", 1), (9, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    got = P.exact_stage(spark, odd(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(4, "y"), (9, "x")]
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(2, long, "en", "s", 1), (4, long + " more", "en", "s", 1), (4, "alone", "en", "s", 1), (4, "alone", "en", "s", 1)]
    got = P.near_stage(spark, odd(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, long), (4, "alone")]
