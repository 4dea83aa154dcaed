"""Phrase mining against a plain count, forced spilling and filters that hit falsely, and odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, m long, f string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, "x", 1, "y") for i, (t, la) in enumerate(rows)], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, least, top, inside):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found = []
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "red", "Fox", "é", "É", "new", "york", "city", "a\x85b", " ", "x y", "日本", "'s", "-"]
    rows = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 25)):
            t += rng.choice([*words, "new york city", "red fox of the"]) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "!"])
        rows.append((t, rng.choice(["en", "en", "en", "fr", None])))
    return rows


ODD = [(None, "en"), ("", "en"), (" \t ", None), ("...", "fr"), ("one", "solo"), ("ab cd " * 20_000, "long"), ("y" * 100_000 + " z", "long")]


@pytest.mark.parametrize("seed, least, inside", [(1, 3, 80), (2, 5, 80), (3, 1, 50), (4, 30, 100)])
def test_phrases_equal_a_plain_count(spark, seed, least, inside):
    rows = texts(seed, 120) * 2 + ODD
    assert got(phrases.collocations(docs(spark, rows), least=least, inside=inside)) == plain(rows, least, 2000, inside)


def test_only_the_first_rows_of_a_language(spark):
    rows = texts(7, 150)
    assert got(phrases.collocations(docs(spark, rows), least=2, top=5)) == plain(rows, 2, 5, 80)


def test_blocks_and_false_hits_change_nothing(spark, monkeypatch):
    rows = texts(11, 200) + ODD
    want = plain(rows, 3, 2000, 80)
    found = phrases.written(phrases.pieces(docs(spark, rows)), "pieces")
    full = {(r.lang, r.phrase): r.f for r in phrases.phrase_counts(found, 3).collect()}
    monkeypatch.setattr(phrases, "frequent_pairs", lambda counts: np.full(phrases.FILTER_BITS >> 6, 2**64 - 1, np.uint64))
    assert {(r.lang, r.phrase): r.f for r in phrases.phrase_counts(found, 3).collect()} == full
    assert got(phrases.collocations(docs(spark, rows), least=3)) == want


def test_a_bucket_beyond_memory_spills(spark, monkeypatch):
    import pyspark.cloudpickle as pickle

    monkeypatch.setattr(phrases, "MEMORY", "40MB")
    rows = spark.range(1_200_000).selectExpr("'en' AS lang", "concat('some phrase with a number ', cast(id % 600000 AS string), repeat('x', 40)) AS phrase", "1L AS f").repartition(1)
    pickle.register_pickle_by_value(phrases)
    try:
        found = phrases.counted(rows, 2)
        assert (found.count(), found.where("f != 2").count()) == (600_000, 0)
    finally:
        pickle.unregister_pickle_by_value(phrases)


def test_large_counts_are_exact(spark):
    big = 10**15
    rows = [("en", "a", 4 * big), ("en", "b", 3 * big), ("en", "a b", 2 * big + 1)]
    r = phrases.scored(phrases.written(spark.createDataFrame(rows, "lang string, phrase string, f long"), "t")).collect()[0]
    assert (r.a, r.l, r.r, r.score) == (2 * big + 1, 4 * big, 3 * big, 2_000_000 * (2 * big + 1) // (7 * big))


def test_empty_table(spark):
    assert phrases.collocations(docs(spark, [("a b", "en")]).where("false")).count() == 0
    assert phrases.collocations(docs(spark, ODD[:4])).count() == 0
