"""Rules over questions, cues, plans, stratified picks, phrases and signals, by known answers and plain versions."""

import json
import random
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import fuzzy, rules, signal
from quillon.operators import phrases as P
from quillon.operators.registry import greedy_stratified
from quillon.plans import case_queries as C

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, hint", [("What happened at 00:03?", "strong"), ("What happened at the start?", "moderate"), ("What happened WHEN it moved?", "weak"), ("Describe the sound.", "none"), ("first or last", "none"), ("100:033", "none"), (None, "none")])
def test_hints(spark, text, hint):
    m = one(spark, rules.temporal_metadata(F.lit(text).cast("string"), F.lit(1.0), F.lit(3.0)))
    assert (m.hint, m.available, m.width_sec, m.executable) == (hint, True, 2.0, hint == "strong")
    assert tuple(one(spark, rules.temporal_metadata(F.lit(text).cast("string"), F.lit(5.0), F.lit(None))))[1:5] == (False, None, None, None)
    assert one(spark, rules.temporal_metadata(F.lit("x"), F.lit(5), F.lit(3))).width_sec == 0.0


@pytest.mark.parametrize(
    "kind, text, need",
    [
        (rules.CROSS_MODAL, "When the person mentioned a card, what was visible?", ["speech", "visual"]), (rules.COUNTING, "How many impact sounds occurred, excluding speech?", ["acoustic"]), (rules.SOUND, "Who said it?", ["acoustic"]),
        (rules.COUNTING, "How often did they unwrap one", ["visual"]), (rules.COUNTING, "How often did they say unwrap", ["speech"]), (rules.TEMPORAL, "x", ["acoustic"]), (rules.SPATIAL, "they said", ["acoustic", "visual"]), (rules.SOUND_SOURCE, "the phrase", ["speech", "visual"]),
        ("another", "the card", ["visual"]), (None, "Who said it", ["acoustic"]), (rules.CAUSAL, None, ["acoustic", "visual"]),
    ],
)
def test_modalities(spark, kind, text, need):
    assert one(spark, rules.expected_modalities(F.lit(text).cast("string"), F.lit(kind).cast("string"))) == need


def test_tags(spark):
    tags = lambda text, kind, width: one(spark, rules.selection_tags(F.lit(text), F.lit(kind), F.lit(width).cast("double")))
    assert tags("How many?", rules.COUNTING, None) == ["challenging_or_fallback_likely", "count_or_aggregation"]
    assert tags("the speaker said it before", rules.CROSS_MODAL, 9.9) == ["cross_modal", "source_or_speaker_attribution", "speech_focused", "temporal_relation"]
    assert tags("x", rules.SOUND, 10) == ["challenging_or_fallback_likely", "direct_acoustic"] and tags("x", "", 3) == []


def test_failures(spark):
    got = lambda t: one(spark, rules.failure_class(F.lit(t).cast("string")))
    assert got(None) is None and got("") is None and got("Service down") == "provider_service_runtime_error" and got("a CONTRACT exhausted") == "other_evidenced_failure"
    assert got("http: PLANNER_provider_exhausted") == "planner_provider_exhausted" and got("shared x contract exhausted") == "shared_contract_exhaustion" and got("Context_Overflow in shared contract exhausted") == "downstream_local_context_overflow"


CUES = {
    "What happened at 01:03?": [("01:03", "explicit_timestamp", 63, 63)],
    "What happened at 00:13–00:14?": [("00:13–00:14", "explicit_time_range", 13, 14)],
    "How many between 17 and 28 seconds?": [("between 17 and 28 seconds", "explicit_time_range", 17, 28)],
    "BETWEEN 00:17 and 00:28 or 1.5": [("BETWEEN 00:17 and 00:28", "explicit_time_range", 17, 28)],
    "between 1:00 and 2:00 - 3:00, 4:05": [("2:00 - 3:00", "explicit_time_range", 120, 180), ("between 1:00 and 2:00", "explicit_time_range", 60, 120), ("4:05", "explicit_timestamp", 245, 245)],
    "1:00-2:00-3:00 12:345": [("1:00-2:00", "explicit_time_range", 60, 120), ("3:00", "explicit_timestamp", 180, 180)],
    "nothing": [], "": [], None: [],
}


@pytest.mark.parametrize("text", CUES)
def test_times_in_questions(spark, text):
    c = one(spark, rules.cues(F.lit(text).cast("string")))
    assert [(x.raw_text, x.cue_type, x.start_sec, x.end_sec) for x in c.time_cues] == CUES[text] and {x.source for x in c.time_cues} <= {"question_text"}


def test_quotes_in_questions(spark):
    c = one(spark, rules.cues(F.lit("Who said “Oh man” after \"Wait\" and '10' ‘x’ \"\" at the very START")))
    assert [(q.raw_text, q.text) for q in c.quoted_phrases] == [("“Oh man”", "Oh man"), ('"Wait"', "Wait"), ("'10'", "10"), ("‘x’", "x")]
    assert [r.raw_text for r in c.relative_temporal_expressions] == ["after", "at the very START"]


GOOD = {
    "answer_requirement": {"operation": "describe_sound", "description": "Describe it."}, "anchor_cues": [{"text": "at the start", "modality": "time"}], "primary_anchor_modality": "time", "resolver_modalities": ["acoustic"], "audio_role": "direct_answer",
    "temporal_relation": "during", "requires_local_visual_inspection": False, "visual_route": "not_required", "fallback_route": "Use it.", "planner_confidence": 0.9, "rationale": "Time anchors the event. Sound resolves it.",
}


def test_plans(spark):
    cases = {
        json.dumps(GOOD): [], json.dumps(GOOD | {"planner_confidence": 1, "resolver_modalities": [], "anchor_cues": []}): [],
        json.dumps(GOOD | {"audio_role": "all", "planner_confidence": 2}): ["invalid audio_role", "planner_confidence must be between 0 and 1"],
        json.dumps(GOOD | {"planner_confidence": True, "requires_local_visual_inspection": "true"}): ["requires_local_visual_inspection must be boolean", "planner_confidence must be between 0 and 1"],
        json.dumps({k: v for k, v in GOOD.items() if k != "rationale"} | {"b": 1, "a": 2}): ["missing field: rationale", "unexpected field: a", "unexpected field: b", "rationale must be non-empty text"],
        json.dumps(GOOD | {"anchor_cues": [{"text": "a", "modality": "x"}, {"text": 1, "modality": "time"}, [], {"text": "a"}]}): ["anchor_cues[0] has invalid values", "anchor_cues[1] has invalid values", "anchor_cues[2] has invalid structure", "anchor_cues[3] has invalid structure"],
        json.dumps(GOOD | {"answer_requirement": None, "anchor_cues": None}): ["answer_requirement must contain exactly operation and description", "anchor_cues must be a list"],
        json.dumps(GOOD | {"resolver_modalities": ["visual", "visual"]}): ["resolver_modalities must be a unique valid list"], json.dumps(GOOD | {"resolver_modalities": "visual"}): ["resolver_modalities must be a unique valid list"], json.dumps(GOOD | {"resolver_modalities": [1]}): ["resolver_modalities must be a unique valid list"],
        json.dumps(GOOD | {"rationale": "A. B! C?"}): ["rationale must contain at most two sentences"], json.dumps(GOOD | {"rationale": " \n"}): ["rationale must be non-empty text"], json.dumps(GOOD | {"fallback_route": 3}): ["fallback_route must be non-empty text"],
        "[]": ["top-level JSON must be an object"], "{": ["top-level JSON must be an object"], None: ["top-level JSON must be an object"], "": ["top-level JSON must be an object"],
    }
    df = spark.createDataFrame([(raw,) for raw in cases], "raw string")
    assert {r.raw: r.e for r in df.select("raw", rules.plan_errors(F.col("raw")).alias("e")).collect()} == cases
    nothing = one(spark, rules.plan_errors(F.lit("{}")))
    assert sum(e.startswith("missing field") for e in nothing) == 11 and len(nothing) == 22


def picked(rows, quotas, earlier, wide):
    left, out = [r for r in rows if r.case_id not in {e.case_id for e in earlier}], []
    types, hints, videos, tags = (Counter(e[k] for e in earlier) for k in ("type", "hint", "video_id", "type"))
    tags = Counter(t for e in earlier for t in e.tags)
    for kind, n in quotas.items():
        while types[kind] < n:
            pool = sorted((hints[r.hint], -sum(tags[t] == 0 for t in r.tags), videos[r.video_id], -(r.width or 0.0) if kind in wide else 0.0, r.case_id) for r in left if r.type == kind)
            best = next(r for r in left if r.case_id == pool[0][-1])
            left.remove(best)
            out.append(best.case_id)
            types[kind] += 1
            hints[best.hint] += 1
            videos[best.video_id] += 1
            tags.update(best.tags)
    return out


def test_stratified_picks(spark):
    cases = C.stratified_cases(spark, "/root/testdata/sf0.01")
    earlier = cases.where("case_id in (0, 1000, 1001, 5002)")
    for known, wide in ((None, ()), (earlier, C.WIDE)):
        got = [r.case_id for r in greedy_stratified(cases, C.QUOTAS, earlier=known, wide=wide).orderBy("pick").collect()]
        assert got == picked(cases.collect(), C.QUOTAS, [] if known is None else known.collect(), wide) and len(got) > 10
    rng = random.Random(1)
    schema = "case_id long, type string, hint string, tags array<string>, video_id long, width double"
    few = spark.createDataFrame([(i, rng.choice("ab"), rng.choice("xy"), rng.sample("pqr", rng.randint(0, 2)), rng.randint(0, 4), rng.choice([None, 1.0, 2.0])) for i in range(80)], schema)
    early = few.where("case_id % 5 = 0")
    for quotas in ({"a": 12, "b": 15}, {"b": 20}):
        assert [r.case_id for r in greedy_stratified(few, quotas, earlier=early, wide=("a",)).orderBy("pick").collect()] == picked(few.collect(), quotas, early.collect(), ("a",))
    with pytest.raises(ValueError, match="too few"):
        greedy_stratified(few, {"a": 81})
    with pytest.raises(ValueError, match="not 30"):
        greedy_stratified(few, {"a": 5}, total=30)
    assert greedy_stratified(few, {"a": 9, "b": 9}, total=7).count() == 7


def brute_ladder(phrase, text, fuzzy_too):
    norm = lambda x: unicodedata.normalize("NFKC", x).strip()
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in norm(x).casefold()).split())
    p, t = norm(phrase), norm(text)
    if p in t:
        return "unicode_normalized_exact", 1.0
    if p.casefold() in t.casefold():
        return "case_insensitive", 0.98
    if plain(p) and plain(p) in plain(t):
        return "punctuation_insensitive", 0.95
    ratio = SequenceMatcher(None, plain(p), plain(t)).ratio()
    return ("token_fuzzy_fallback", round(ratio, 6)) if fuzzy_too and ratio >= 0.6 else None


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_ladder_equals_plain_rules(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_BYTES", block)
    phrases = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()] + [(100, ""), (101, None), (102, "!?"), (103, "a"), (104, "ﬁ _x"), (105, "ß"), (106, "ß"), (107, "A-B")]
    texts = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").limit(30).collect()]
    texts += [phrases[0][1].upper(), ", ".join(phrases[1][1].split()), phrases[2][1][: len(phrases[2][1]) * 2 // 3] + " tail", "", None, "Ünïcode ﬁ", "why!?", "STRASSE fi x a b", "x" * 100_000 + " " + phrases[3][1]]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = spark.createDataFrame(phrases, "k long, phrase string")
    for run, fuzzy_too in ((P.contained, False), (P.laddered, True)):
        got = {(r.doc_id, r.k): (r.method, r.score) for r in run(t, p).collect()}
        want = {(i, k): m for i, x in enumerate(texts) for k, y in phrases if (m := brute_ladder(y or "", x or "", fuzzy_too))}
        assert got == want and len({m for m, _ in want.values()}) == 3 + fuzzy_too
    assert P.contained(t, p.where("false")).count() == P.contained(t.where("false"), p).count() == 0


def damaged(rng, phrase, letters):
    """A phrase as it may be heard: letters left out and others put in, or a piece of it in its place, or words out of order."""
    much, style = rng.uniform(0.3, 0.8), rng.random()
    other = lambda n: "".join(rng.choice(letters) for _ in range(n))
    if style < 0.4:
        out = "".join((c if rng.random() < much else "") + (other(1) if rng.random() < 0.6 - 0.6 * much else "") for c in phrase)
    elif style < 0.7:
        at = rng.randint(0, len(phrase) // 3)
        out = other(rng.randint(0, len(phrase) // 4)) + phrase[at : at + int(len(phrase) * much)] + other(rng.randint(0, len(phrase) // 4))
    else:
        parts = [phrase[i : i + 9] for i in range(0, len(phrase), 9)]
        rng.shuffle(parts) if rng.random() < 0.3 else None
        out = "".join(x if rng.random() < 0.9 else other(7) for x in parts if rng.random() < much + 0.15)
    return out[: rng.choice([199, 200, 201, 10_000])]


@pytest.mark.parametrize("letters, shared, side", [("ab ", 1 << 22, 64), ("etaoinshrdlu ", 500, 64), ("".join(map(chr, range(0x4E00, 0x4E00 + 2000))), 1 << 22, 2)])
def test_last_rung_equals_the_sequence_matcher(monkeypatch, letters, shared, side):
    for name, value in (("SHARED", shared), ("SIDE_BY_SIDE", side), ("LETTERS", 1 << 16 if shared > 500 else 50)):
        monkeypatch.setattr(fuzzy, name, value)
    rng = random.Random(len(letters))
    phrases = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 3, 20, 60, 120, 150, 190, 230, 300, 400, 470)]
    texts = ["", "a", *(damaged(rng, rng.choice(phrases), letters) for _ in range(60))]
    passed = [{rng.randrange(12)} if rng.random() < 0.2 else set() for _ in texts]
    want = {(n, k): round(r, 6) for n, t in enumerate(texts) for k, p in enumerate(phrases) if k not in passed[n] and (r := SequenceMatcher(None, p, t).ratio()) >= 0.6}
    assert {(n, k): r for n, k, r in fuzzy.Alike(phrases).search(texts, passed)} == want and len(want) > 20


def test_last_rung_matches_few_pairs_letter_by_letter(spark, monkeypatch):
    made = []
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    phrases = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    texts.append(phrases[3][: len(phrases[3]) * 2 // 3])
    found = list(P._laddered([*phrases, phrases[3] + " and a tail"])(texts))
    assert (len(texts) - 1, 3) in {x[:2] for x in found} and len(made) < len(texts) * len(phrases) / 500


def test_ambiguity(spark):
    rows = [(1, 7, 1.0), (2, 7, 0.98), (0, 7, 0.98), (5, 8, 1.0)]
    got = P.with_ambiguity(spark.createDataFrame(rows, "doc_id long, k long, score double"), ["k"], F.col("doc_id")).collect()
    assert {(r.doc_id, r.k, r.position, r.n_matches, r.ambiguity_warning) for r in got} == {(1, 7, 1, 3, W), (0, 7, 2, 3, W), (2, 7, 3, 3, W), (5, 8, 1, 1, None)}


W = "multiple_possible_matches"


def plain_features(x, rate, window, hop, smoothing):
    size, step = max(32, round(window * rate)), max(1, round(hop * rate))
    n = 1 if len(x) <= size else 1 + -(-(len(x) - size) // step)
    pad = np.concatenate([x, np.zeros(size + n * step)])
    f = np.array([pad[i * step : i * step + size] for i in range(n)])
    mag = np.abs(np.fft.rfft(f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)), axis=1))
    rms = np.sqrt((f * f).mean(1) + 1e-12)
    shape, log = mag / (mag.sum(1, keepdims=True) + 1e-10), np.log1p(100 * mag)
    flux, move, level = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        flux[i] = np.sqrt((np.clip(shape[i] - shape[i - 1], 0, None) ** 2).sum())
        move[i] = np.abs(log[i] - log[i - 1]).mean()
        level[i] = abs(np.log(rms[i] + 1e-8) - np.log(rms[i - 1] + 1e-8))
    over = lambda v: np.clip((v - np.median(v)) / (1.4826 * np.median(abs(v - np.median(v))) + 1e-8), 0, None)
    raw = 0.4 * over(flux) + 0.4 * over(move) + 0.2 * over(level)
    k = min(n, max(1, round(smoothing / hop)))
    return np.column_stack([np.minimum(np.arange(n) * hop + window / 2, len(x) / rate), rms, flux, move, np.convolve(raw, np.ones(k) / k, mode="same")])


def test_signals_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    waves = {k: rng.normal(size=n) for k, n in enumerate((333, 40, 41, 39, 1, 75, 60, 1000))}
    waves[9] = np.array([])
    rows = [(k, i, float(v)) for k, x in waves.items() for i, v in enumerate(x)] + [(9, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "key long, i long, value double").repartition(7)
    for smoothing in (1.0, 0.3, 2.5):
        got = signal.acoustic(df, "key", 40, 1.0, 0.25, smoothing).orderBy("key", "frame").collect()
        for k, x in waves.items():
            own = np.array([r[2:] for r in got if r.key == k])
            assert [r.frame for r in got if r.key == k] == list(range(len(own)))
            np.testing.assert_allclose(own, plain_features(x, 40, 1.0, 0.25, smoothing), rtol=1e-6, atol=1e-9)
    bad = df.withColumn("value", F.when(F.col("i") % 3 == 0, F.lit(float("nan"))).when(F.col("i") % 3 == 1, F.lit(None)).otherwise(F.col("value")))
    x = np.where(np.arange(333) % 3 == 2, waves[0], 0.0)
    np.testing.assert_allclose(np.array([r[2:] for r in signal.acoustic(bad.where("key = 0"), "key", 40, 1.0, 0.25, 1.0).orderBy("frame").collect()]), plain_features(x, 40, 1.0, 0.25, 1.0), rtol=1e-6, atol=1e-9)
    assert fuzzy.letters("a_b--c") == "a b c"
