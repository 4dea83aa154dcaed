"""Operators on literal rows: ties, ends that touch, empty inputs, and the decided quirks."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import rules, stats, text, vectors
from quillon.operators import folds, evaluate, evidence, intervals, lineage, ranking, registry, series
from quillon.schemas import schema_key_leaks
from quillon.sources import files

IV = "video_id int, id long, start_sec double, end_sec double"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def iv(spark, *xs):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(xs)], IV)


def test_overlap_ends(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert not one(spark, intervals.overlaps(*lit(0, 2, 2, 3)))
    assert one(spark, intervals.overlaps_closed(*lit(0, 2, 2, 3)))
    assert one(spark, intervals.distance(*lit(0, 2, 4, 5))) == 2
    assert one(spark, intervals.distance(*lit(4, 5, 0, 2))) == 2


def test_merge_union_gaps_subtract(spark):
    x = iv(spark, (0, 2), (1, 5), (5, 6), (9, 10))
    assert rows(intervals.merged(x, ["video_id"]).select("start_sec", "end_sec", "n_sources")) == [(0.0, 6.0, 3), (9.0, 10.0, 1)]
    assert intervals.union_duration(x, ["video_id"]).first().union_seconds == 7
    assert rows(intervals.gaps(intervals.merged(x, ["video_id"]), ["video_id"]).select("gap_start", "gap_end")) == [(6.0, 9.0)]
    left = intervals.subtracted(iv(spark, (0, 12)), x, ["video_id"])
    assert rows(left.select("left_start", "left_end")) == [(10.0, 12.0), (6.0, 9.0)]


def test_bucketed_join_equals_plain(spark):
    a = iv(spark, *[(i * 3, i * 3 + 7) for i in range(40)])
    b = iv(spark, *[(i * 5, i * 5 + 11) for i in range(30)])
    pick = ["id", "id_r"]
    A, B = a.collect(), b.collect()
    plain = lambda hit: sorted(((x.id, y.id) for x in A for y in B if hit(x, y)), key=str)
    assert rows(intervals.interval_join(a, b, ["video_id"], 10.0).select(pick)) == plain(lambda x, y: x.start_sec < y.end_sec and x.end_sec > y.start_sec)
    assert rows(intervals.interval_join(a, b, ["video_id"], 10.0, closed=True).select(pick)) == plain(lambda x, y: not (x.end_sec < y.start_sec or y.end_sec < x.start_sec))


def test_left_interval_join_needs_an_overlap(spark):
    a = iv(spark, (0, 1), (4, 7), (4, 7)).unionByName(spark.createDataFrame([(2, 9, 0.0, 3.0), (None, 10, 0.0, 1.0)], IV))
    b = iv(spark, (5, 6), (6, 9))
    got = rows(intervals.interval_join(a, b, ["video_id"], 3.0, how="left").select("video_id", "id", "id_r"))
    assert got == sorted([(1, 0, None), (1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 9, None), (None, 10, None)], key=str)
    with pytest.raises(ValueError, match="full"):
        intervals.interval_join(a, b, ["video_id"], how="full")


@pytest.mark.parametrize("closed", ["left", "both", "neither"])
def test_points_and_closed_ends(spark, closed):
    spans = iv(spark, (0, 10), (10, 20), (5, 5))
    pts = spark.createDataFrame([(1, float(t)) for t in (0, 5, 10, 15, 20)], "video_id int, t double")
    ok = {"left": lambda s, e, t: s <= t < e, "both": lambda s, e, t: s <= t <= e, "neither": lambda s, e, t: s < t < e}[closed]
    want = sorted(((i, float(t)) for i, (s, e) in enumerate([(0, 10), (10, 20), (5, 5)]) for t in (0, 5, 10, 15, 20) if ok(s, e, t)), key=str)
    assert rows(intervals.points_in(spans, pts, ["video_id"], width=4.0, closed=closed).select("id", "t")) == want


def test_nearest_and_subtract_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    made = lambda n: [(s := rng.randint(0, 200), s + rng.randint(0, 9)) for _ in range(n)]
    A, B = made(60), made(25)
    a, b = iv(spark, *A), iv(spark, *B)
    got = {r.id: (r.nearest_id, r.dist) for r in intervals.nearest(a, b, ["video_id"], 7.0).collect()}
    gap = lambda x, y: max(0.0, y[0] - x[1], x[0] - y[1])
    assert got == {i: (min(range(25), key=lambda j: (gap(x, B[j]), j)), min(gap(x, y) for y in B)) for i, x in enumerate(A)}
    left = {}
    for r in intervals.subtracted(a, b, ["video_id"], 7.0).collect():
        left.setdefault(r.id, set()).update(range(int(r.left_start), int(r.left_end)))
    cut = {t for s, e in B for t in range(s, e)}
    assert left == {i: rest for i, (s, e) in enumerate(A) if (rest := set(range(s, e)) - cut)}


def test_cover_counts_twice_and_caps(spark):
    r = intervals.cover_ratio(iv(spark, (0, 4)), iv(spark, (1, 3), (1, 3)), ["video_id"]).first().ratio
    assert r == 1.0
    assert intervals.cover_ratio(iv(spark, (0, 4)), iv(spark, (1, 3)), ["video_id"]).first().ratio == 0.5


def test_cover_of_an_item_without_duration_is_zero(spark):
    got = intervals.cover_ratio(iv(spark, (2, 2), (5, 6)), iv(spark, (0, 4)), ["video_id"])
    assert rows(got.select("id", "ratio")) == [(0, 0.0), (1, 0.0)]


def test_clip_takes_later_start_on_ties(spark):
    got = intervals.clip_to_best(iv(spark, (0, 10)), iv(spark, (0, 3), (5, 8)), ["video_id"]).first()
    assert (got.clip_start, got.clip_end) == (5, 8)


@pytest.mark.parametrize(("n", "duration", "want"), [(0, 0.0, []), (3, 3.0, [(0, 3)]), (7, 7.0, [(0, 4), (2, 6)]), (8, 8.0, [(0, 4), (2, 6), (4, 8)]), (8, 8.2, [(0, 4), (2, 6), (4, 8), (6, 8)]), (9, 9.0, [(0, 4), (2, 6), (4, 8)])])
def test_sliding_windows(spark, n, duration, want):
    assert [tuple(x) for x in one(spark, series.sliding_windows(F.lit(n), 4, 2, F.lit(duration)))] == want


def test_fixed_windows_have_a_last_one_at_a_multiple(spark):
    assert [tuple(x) for x in one(spark, series.fixed_windows(F.lit(30.0), 15))] == [(0, 14), (15, 29), (30, 30)]


def test_min_max_of_equal_values_is_one(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 5.0)], "k int, v double").select(series.min_max("v", ["k"]).alias("x"))
    assert {r.x for r in df.collect()} == {1.0}


def taken(spark, times, rule, needs=("t",), fill=0):
    df = spark.createDataFrame([(1, float(t), i, i) for i, t in enumerate(times)], "k int, t double, id int, place int")
    return [r.id for r in folds.walked(df, ["k"], ["place"], list(needs), rule, fill).orderBy("pick").collect()]


def test_greedy_orders(spark):
    assert taken(spark, [5, 6, 20, 7], lambda: folds.Apart(10.0, 3)) == [0, 2]
    assert taken(spark, [5, 6, 20, 7], lambda: folds.Apart(10.0, 3), fill=3) == [0, 2, 1]


def test_segments_measure_from_current_start(spark):
    points = [(0, 0.0), (1, 0.9), (2, 0.9), (3, 0.9), (5, 0.9), (6, 0.1), (8, 0.0)]
    df = spark.createDataFrame([(1, float(t), x) for t, x in points], "k int, t double, distance double")
    assert [r.t for r in folds.walked(df, ["k"], ["t"], ["t", "distance"], lambda: folds.Segments(0.18, 2.0)).orderBy("t").collect()] == [0, 2, 5]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(1, 0), v(-1, 0))) == -1
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0, 0))) is None


def test_top_k_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.9)], "q int, id int, s double")
    assert [r.id for r in ranking.top_k(df, ["q"], 2, F.desc("s"), F.col("id")).orderBy("rank").collect()] == [3, 1]
    assert ranking.top_k(df.where("false"), ["q"], 2, F.desc("s")).count() == 0


def test_mcnemar_and_wilson(spark):
    def exact(b, c):
        n, k = b + c, min(b, c)
        return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    for b, c in [(0, 0), (1, 0), (3, 9), (10, 10), (700, 900)]:
        assert one(spark, stats.mcnemar_exact(F.lit(b), F.lit(c))) == pytest.approx(exact(b, c), rel=1e-9)
    lo, hi = stats.wilson(F.lit(81), F.lit(300))
    assert one(spark, lo) == pytest.approx(0.2229, abs=1e-4) and one(spark, hi) == pytest.approx(0.3229, abs=1e-4)
    assert one(spark, stats.erfc(F.lit(0.7))) == pytest.approx(math.erfc(0.7), rel=1e-6)


def test_nearest_rank_and_holm(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 21)], "k int, v double")
    assert stats.nearest_rank(df, ["k"], "v", 0.95).first().nearest_rank == 19
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.p_holm, 6) for r in stats.holm(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_retry_merge(spark):
    a = spark.createDataFrame([(1, 0, "success", "A"), (1, 1, "success", "B"), (2, 0, "timeout", ""), (2, 1, "success", "C"), (3, 0, "error", ""), (3, 1, "success", "x")], "uid int, attempt int, status string, pred string")
    assert {r.uid: r.attempt for r in evaluate.retry_merge(a).collect()} == {1: 0, 2: 1, 3: 1}


def test_texts(spark):
    assert one(spark, text.tokens(F.lit("Elephant used 42"))) == ["elephant", "used", "42"]
    assert one(spark, text.tokens_compat(F.lit("elephant used 42"))) == ["e", "lephant", "u", "sed", "4", "2"]
    assert one(spark, text.parse_choice(F.lit("no"))) is None
    assert one(spark, text.clock_to_seconds(F.lit("75:30"))) == 4530
    assert one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []


def test_sources(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    files.write_checkpoint(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_checkpoint(df, str(tmp_path / "c"))
    (tmp_path / "x.srt").write_text("1\n00:00:01,500 --> 00:00:01,000\nhello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n \n")
    got = files.read_srt(spark, str(tmp_path / "x.srt")).first()
    assert (got.start_sec, got.end_sec, got.text) == (1.5, 2.5, "hello there")


def test_clocks_and_ranges(spark):
    z = lambda t: one(spark, rules.clock_or_zero(F.lit(t)))
    assert [z(t) for t in ("", "12,5", "1:02", "01:02:03,250", "x1:02", "abc", "1:2:3:4", " 7 ")] == [0, 12.5, 62, 3723.25, 62, 0, 0, 7]
    r = lambda t: tuple(one(spark, rules.time_range(F.lit(t))))
    assert r("0:05 - 1:10") == (5, 70, []) and r("1:00:00–1:00:00.5") == (3600, 3600.5, []) and r(None) == (None, None, []) and r(" ") == (None, None, [])
    assert r("2:00-1:00") == (None, None, ["invalid_provided_timestamp:2:00-1:00"]) and r("soon") == (None, None, ["unparsed_provided_timestamp:soon"])


def test_options_entities_and_texts(spark):
    top, label = rules.best_option({k: F.lit(v) for k, v in zip("ABCDE", (0.1, 0.7, 0.7, 0.2, 0.0), strict=True)})
    assert (one(spark, top), one(spark, label)) == (0.7, "B")
    assert one(spark, rules.best_option({"A": F.lit(1.0), "B": F.lit(float("nan"))})[1]) is None
    item = lambda t, n, v: F.struct(*[F.lit(x).cast("string").alias(k) for k, x in (("text", t), ("name", n), ("value", v))])
    assert one(spark, rules.entity_texts(F.array(item("a ", None, None), item("", "b", None), item(None, None, "a"), item(None, None, " "), item(None, None, None)))) == ["a", "b"]
    assert one(spark, rules.coarse_text(F.lit(None), F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>"))) == " x y "
    assert one(spark, rules.visual_tokens(F.lit(4), F.lit(112))) == 64 and one(spark, rules.visual_tokens(F.lit(4), F.lit(100))) is None and one(spark, rules.visual_tokens(F.lit(300), F.lit(112))) is None


def test_metrics_are_isolated(spark):
    m = registry.Metrics(registry.Metric("ok", "c", lambda d: F.col("a") * 2), registry.Metric("later", "c", None), registry.Metric("broken", "c", lambda d: F.col("none")), registry.Metric("text", "c", lambda d: F.lit("x")))
    got = {r.metric: (r.value, r.available, r.error) for r in m.evaluate(spark.createDataFrame([(1, 2)], "id int, a int"), ["id"]).collect()}
    assert got == {"ok": (4.0, True, None), "later": (None, False, None), "broken": (None, False, "AnalysisException"), "text": (None, True, None)}
    with pytest.raises(ValueError, match="already"):
        m.register(registry.Metric("ok", "c", None))


def test_backends_agree_where_they_must(spark):
    v = [(i, f"word{i} common", [float(i == k) for k in range(4)], i % 2) for i in range(4)]
    x = spark.createDataFrame(v, "doc_id long, text string, vec array<double>, group int")
    q = spark.createDataFrame([(7, "word2", [0.0, 0.1, 0.9, 0.0])], "query_id long, text string, vec array<double>")
    for name in registry.BACKENDS:
        assert registry.retrieve(q, x, name, 1).first().doc_id == 2, name
    own = lambda queries, index: index.select(F.lit(7).alias("query_id"), "doc_id", (-F.col("doc_id")).alias("score"))
    assert registry.retrieve(q, x, own, 1).first().doc_id == 0
    for bad in ({"backend": "none"}, {"k": 0}):
        with pytest.raises(ValueError, match="none|at least"):
            registry.retrieve(q, x, **bad)


def test_spans_of_a_text(spark):
    got = one(spark, rules.text_spans(F.lit("from 00:01:00 - 00:02:30, 3:10-3:05, 1:00 to 2:00 and 5:00–6:00"), 2))
    assert [(x.start_sec, x.end_sec) for x in got] == [(60, 150), (60, 120)]
    assert one(spark, rules.text_spans(F.lit(None).cast("string"), 2)) == []


def test_budget_violations(spark):
    got = evidence.budget_violations(iv(spark, (0, 5), (3, 8), (20, 21)), "video_id", 2, 9.0)
    assert rows(got) == [(1, 3, 9.0, "count")]
    assert rows(evidence.budget_violations(iv(spark, (0, 5), (3, 8)), "video_id", 2, 7.5)) == [(1, 2, 8.0, "seconds")]


def test_review_samples_are_disjoint(spark):
    df = spark.range(200).withColumnRenamed("id", "uid")
    got = registry.review_samples(df, "uid", [("a", F.col("uid") < 100, 20), ("b", F.col("uid") < 50, 30), ("c", F.lit(True), 500)], "s").collect()
    assert len({r.uid for r in got}) == len(got) == 200 and [sum(r.bucket == k for r in got) for k in "abc"] == [20, 30, 150]


def test_trees_of_hashes(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    df = spark.createDataFrame([("k", i, f"t{i}") for i in range(25)] + [("e", 3, None)], "k string, o long, t string")
    blocks = [sha("".join(sha(f"t{i}") for i in range(a, min(a + 5, 25)))) for a in range(0, 25, 5)]
    got = {r.k: r.sha for r in lineage.tree_sha(df, "k", "o", "t", fan=5, levels=1).collect()}
    assert got == {"k": sha("".join(blocks)), "e": sha(sha(sha("")))}


def test_manifests_and_ledgers(spark):
    m = lambda *r: spark.createDataFrame(r, "path string, bytes long, sha string")
    assert rows(lineage.verify(m(("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")), m(("a", 1, "x"), ("b", 2, "q"), ("d", 4, "w")))) == [("b", "changed"), ("c", "missing"), ("d", "unexpected")]
    c = spark.createDataFrame([(1, "p", 1, 5.0), (1, "p", 2, 5.0), (1, "q", 3, 6.0), (2, "r", 1, 11.0)], "account int, charge string, seq int, usd double")
    assert rows(lineage.ledger(c, "account", "charge", "seq", "usd", 10.0)) == [(1, "p", 5.0, True), (1, "q", 11.0, False), (2, "r", 11.0, False)]
    assert lineage.run_fingerprint(a="1", b="2") == lineage.run_fingerprint(b="2", a="1") != lineage.run_fingerprint(a="2", b="1")


def test_lineage(spark):
    df = spark.createDataFrame([(1, "a")], "id int, gold string")
    assert schema_key_leaks(df.select(F.struct("gold").alias("s")), {"gold"}) == ["s.gold"]
    assert lineage.schema_hash(df) == lineage.schema_hash(df.select("gold", "id"))
    j = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "sent"), ("a", 3, "checkpointed")], "k string, o int, state string")
    r = lineage.journal_replay(j, ["k"], ["o"]).first()
    assert (r.last_state, r.n_illegal, r.unfinished) == ("checkpointed", 1, False)


def test_phrase_windows_equal_brute_force():
    import random
    from difflib import SequenceMatcher

    from quillon.functions import fuzzy

    def brute(text, phrase):
        p, t = fuzzy.normalized(phrase), fuzzy.normalized(text)
        if not p or not t:
            return 0.0
        if p in t:
            return 1.0
        w, n = t.split(), len(p.split())
        return max(SequenceMatcher(None, p, " ".join(w[i : i + n])).ratio() for i in range(max(1, len(w) - n + 1)))

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéñoprstu") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def spoiled(words, every):
        return [w[1:] + "x" if i % every == every - 1 else w for i, w in enumerate(words)]

    phrases = [prose(n) for n in (1, 2, 3, 5, 12, 12, 30, 45)]
    made = [" ".join(p) for p in phrases] + ["Straße, 20!", "", "?"]
    texts = [" ".join(prose(k) + spoiled(p, e) + prose(9)) for k, p in enumerate(phrases) for e in (2, 3, 4, 7)]
    texts += [", ".join(p).upper() + "." for p in phrases] + [" ".join(prose(60)) for _ in range(8)] + ["STRASSE 20", "", "a", " ".join(phrases[4][:10])]
    found = fuzzy.Phrases(made)
    hits = 0
    for t in texts:
        want = {k: round(r, 6) for k, p in enumerate(made) if (r := brute(t, p)) >= 0.85}
        assert dict(found.matches(t)) == want
        hits += len([r for r in want.values() if r < 1])
    assert hits > 12


def test_resumed_work(spark, tmp_path):
    seen = []
    work = lambda d: (seen.append(sorted(r.k for r in d.collect())), d)[1]
    out = str(tmp_path / "done")
    cases = spark.createDataFrame([(i,) for i in range(5)], "k int")
    files.resume(spark, cases.where("k < 2"), out, "k", work)
    assert rows(files.resume(spark, cases, out, "k", work)) == [(i,) for i in range(5)] and seen == [[0, 1], [2, 3, 4]]
