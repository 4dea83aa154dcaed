"""Shared terms counted inside tasks, against brute force."""

import random

import pytest

from quillon.operators import blocks
from quillon.operators import lexical as X
from quillon.plans import registry


@pytest.mark.parametrize("cells", [1_000_000, 25])
def test_shared_terms_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(blocks, "SCORES", cells)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    some = lambda: rng.sample(words, rng.randint(0, 8))
    q, d = [(i, some()) for i in range(9)], [(i, some()) for i in range(70)] + [(70, None)]
    x = spark.createDataFrame(d, "doc_id long, w array<string>").repartition(3)
    asked = spark.createDataFrame(q, "query_id long, w array<string>")
    share = {(i, j): round(len(set(a) & set(b or [])) / max(1, len(a)), 6) for i, a in q for j, b in d}
    got = {(r.query_id, r.doc_id): r.lexical for r in blocks.over_terms(x, asked, X.above(0.5), X.PAIR).collect()}
    assert got == pytest.approx({k: s for k, s in share.items() if s > 0.5})
    near = blocks.over_terms(x.coalesce(1), asked, X.nearest(4), X.PAIR).collect()
    for i, _ in q:
        want = sorted((-s, j) for (k, j), s in share.items() if k == i and s > 0)[:4]
        assert sorted((-r.lexical, r.doc_id) for r in near if r.query_id == i) == [(pytest.approx(s), j) for s, j in want]
    units = {(r.unit, r.doc_id): (r.lexical, r.best_query, r.queries) for r in blocks.over_terms(x, asked, X.units(4, 0.4), X.UNIT).collect()}
    for u in range(4):
        for j, _ in d:
            own = [(share[i, j], -i) for i, _ in q if i % 4 == u and share[i, j] > 0]
            if own and max(own)[0] > 0.4:
                s, i = max(own)
                assert units.pop((u, j)) == (pytest.approx(s), -i, ",".join(str(-i) for _, i in sorted(own, key=lambda o: -o[1])))
    assert not units


def test_too_many_terms_are_left_to_a_join(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TERMS", 2)
    x = spark.createDataFrame([(1, ["a", "b", "c"])], "query_id long, w array<string>")
    assert blocks.over_terms(x.withColumnRenamed("query_id", "doc_id"), x, X.above(0.5), X.PAIR) is None


@pytest.mark.parametrize("terms", [1_000_000, 6])
def test_every_pair_is_there_however_little_it_shares(spark, monkeypatch, terms):
    monkeypatch.setattr(blocks, "TERMS", terms)
    monkeypatch.setattr(blocks, "SCORES", 20)
    q = [(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, []), (3, ["b", "c"]), (None, ["a", "q"])]
    d = [(7, ["a", "b"]), (8, ["c", "z"]), (8, ["c", "z"]), (9, []), (10, None), (None, ["x"])]
    got = blocks.over_every_term(spark.createDataFrame(d, "doc_id long, w array<string>"), spark.createDataFrame(q, "query_id long, w array<string>"), X.every, X.PAIR)
    share = [(i, j, len(set(a) & set(b or [])) / max(1, len(a))) for i, a in q for j, b in d]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, share))


def test_lexical_similarity_of_every_query_and_text(spark):
    sf = "/root/testdata/sf0.001"
    items, docs = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("benchmark", "documents"))
    got = registry.QUERIES["lexical_similarity"].run(spark, sf)
    assert got.count() == items * docs and 0 < got.where("lexical <= 0.5").count() < items * docs
