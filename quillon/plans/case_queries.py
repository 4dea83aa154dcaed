"""Queries over questions and cases: rules, options, samples, ledgers, manifests, metrics and backends."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as Q
from ..functions import vectors as V
from ..functions.signal import acoustic
from ..operators import lineage as L
from ..operators import phrases as P
from ..operators import ranking as R
from ..operators import registry as G
from ..operators.scans import Ordered
from ..sources import arrays as A
from ..sources import files as S
from ..sources.documents import write_json_atomic
from .fixtures import AT, IV, attempts, intervals, table
from .registry import query


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


TYPE = r"""CASE WHEN regexp_matches(lower(coalesce(text, '')), '\bhow many\b|\bnumber of\b|\bcount(?:ing|ed|s)?\b') THEN 'counting'
 WHEN regexp_matches(lower(coalesce(text, '')), '\bbefore\b|\bafter\b|\bfirst\b|\blast\b|\bthen\b|\bsequence\b|\bthroughout\b|\bchange\b|\buntil\b|\bbetween\b') THEN 'temporal_or_change'
 WHEN regexp_matches(lower(coalesce(text, '')), '\bwhy\b|\bpurpose\b|\bobjective\b|\bcontribut|\bsignificance\b|\bdeduce\b|\binfer') THEN 'causal_goal_inference'
 WHEN regexp_matches(lower(coalesce(text, '')), '\bwhere\b|\blocation\b') THEN 'spatial'
 WHEN regexp_matches(lower(coalesce(text, '')), '\bwho\b|\bperson\b|\bcharacter\b|\bpeople\b|\binteraction') THEN 'person_interaction'
 WHEN regexp_matches(lower(coalesce(text, '')), '\boverall\b|\boverarching\b|\bprimary\b|\bmain\b|\btheme\b|\bsummar') THEN 'global_summary' ELSE 'action_object_detail' END"""
# RE2 has no look-around: a clock time between what is no digit
HINT = r"""CASE WHEN regexp_matches(t, '(?:^|\D)\d{1,2}:\d{2}(?:\D|$)') THEN 'strong'
 WHEN regexp_matches(t, '(?i)\b(at the (very )?start|at the beginning|at the end|before|after|between|during)\b') THEN 'moderate'
 WHEN regexp_matches(t, '(?i)\b(when|while|then|following|followed|throughout|span|clip|earlier|later)\b') THEN 'weak' ELSE 'none' END"""

#: Questions: a few words that rules look for, by number, before every turn's own text; a kind, and a span for four of five.
LEADS = (
    "", "Where does the voice come from", "Who said it, excluding speech", "How many boxes did they unwrap", "At the very start", "While the clip runs in the background", "Which object is shown",
    "What did they mention after 0:35", "Describe the tone", "What happened at the end, most of the clip", "in direction of the camera",
)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    c, i = _turns(spark, d), F.col("conv_id") + F.col("turn")
    lead = F.get(F.array(*map(F.lit, LEADS)), (i % len(LEADS)).cast("int"))
    kind = F.get(F.array(*map(F.lit, [*Q.KINDS, "Other"])), (i % 8).cast("int"))
    start = F.when(F.col("conv_id") % 5 > 0, F.col("turn") * 3)
    return c.select("conv_id", "turn", F.concat_ws(" ", lead, "text").alias("question"), kind.alias("kind"), start.alias("start"), (start + F.char_length("text") % 25 - 2).alias("end"))


QUESTIONS = """qs AS (SELECT conv_id, turn, (['', 'Where does the voice come from', 'Who said it, excluding speech', 'How many boxes did they unwrap', 'At the very start', 'While the clip runs in the background', 'Which object is shown',
  'What did they mention after 0:35', 'Describe the tone', 'What happened at the end, most of the clip', 'in direction of the camera'])[(conv_id + turn) % 11 + 1] || ' ' || text AS t,
 (['Sound Source Identification', 'Sound Characteristics', 'Cross-Modal Reasoning', 'Counting', 'Temporal Information', 'Spatial Location (Direction & Distance)', 'Inferential & Contextual Causality', 'Other'])[(conv_id + turn) % 8 + 1] AS kind,
 CASE WHEN conv_id % 5 > 0 THEN turn * 3.0 END AS s, CASE WHEN conv_id % 5 > 0 THEN turn * 3.0 + length(text) % 25 - 2 END AS e FROM conversations)"""


# -- rules over whole texts --------------------------------------------------------


@query(f"SELECT doc_id, {TYPE} AS type FROM documents")
def question_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Q.question_type(F.col("text")).alias("type"))


@query(rf"WITH {QUESTIONS} SELECT conv_id, turn, {HINT} AS hint, s IS NOT NULL AS available, s::DOUBLE AS start_sec, e::DOUBLE AS end_sec, greatest(0.0, e - s)::DOUBLE AS width_sec, regexp_matches(t, '(?:^|\D)\d{{1,2}}:\d{{2}}(?:\D|$)') AS executable FROM qs".replace("greatest(0.0, e - s)", "CASE WHEN s IS NOT NULL THEN greatest(0.0, e - s) END"))
def temporal_hint(spark: SparkSession, d: str) -> DataFrame:
    """How strongly a question points to a time, and its given span."""
    return _questions(spark, d).select("conv_id", "turn", Q.temporal_metadata(F.col("question"), F.col("start"), F.col("end")).alias("m")).select("conv_id", "turn", "m.*")


NEEDS = rf"""{QUESTIONS}, h AS (SELECT *, regexp_matches(t, '(?i)\b(say|said|says|spoken|speech|voice|phrase|conversation|respond|reply|exclaim|remark|counting|mention|mentioned|tell|told|utter|audio line)\b') AND NOT regexp_matches(t, '(?i)\b(excluding|exclude|without)\s+speech\b') AS heard FROM qs),
n AS (SELECT *, CASE WHEN kind = 'Sound Characteristics' THEN ['acoustic'] WHEN kind LIKE 'Spatial%' THEN ['acoustic', 'visual'] WHEN kind = 'Other' AND regexp_matches(t, '(?i)\b(visual|visibly|camera|shown|displayed|focus|object|card|action|where|direction)\b') THEN ['visual'] WHEN kind = 'Other' THEN ['acoustic']
 WHEN kind = 'Counting' AND NOT heard AND regexp_matches(t, '(?i)\b(transfer|place|unwrap|action)\b') THEN ['visual'] WHEN kind IN ('Counting', 'Temporal Information') THEN [CASE WHEN heard THEN 'speech' ELSE 'acoustic' END] ELSE [CASE WHEN heard THEN 'speech' ELSE 'acoustic' END, 'visual'] END AS need FROM h)"""


@query(f"WITH {NEEDS} SELECT conv_id, turn, array_to_string(need, ',') AS modalities FROM n")
def expected_modalities(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("conv_id", "turn", F.array_join(Q.expected_modalities(F.col("question"), F.col("kind")), ",").alias("modalities"))


TAGGED = rf"""{NEEDS}, tags AS (SELECT *, list_sort(list_filter([CASE WHEN kind = 'Counting' THEN 'count_or_aggregation' END, CASE WHEN kind = 'Cross-Modal Reasoning' OR len(need) > 1 THEN 'cross_modal' END, CASE WHEN kind = 'Sound Characteristics' THEN 'direct_acoustic' END,
 CASE WHEN list_contains(need, 'speech') THEN 'speech_focused' END, CASE WHEN regexp_matches(t, '(?i)\b(before|after|followed|following|sequence|quickly|time|duration)\b') THEN 'temporal_relation' END, CASE WHEN regexp_matches(t, '(?i)\b(source|speaker|male|female|passenger|who|where|direction)\b') THEN 'source_or_speaker_attribution' END,
 CASE WHEN kind = 'Counting' OR e - s >= 10 OR regexp_matches(t, '(?i)\b(background|distant|multiple|continuous|throughout|most of the clip)\b') THEN 'challenging_or_fallback_likely' END], lambda x: x IS NOT NULL)) AS tags FROM n)"""


@query(f"WITH {TAGGED} SELECT conv_id, turn, array_to_string(tags, ',') AS tags FROM tags")
def selection_tags(spark: SparkSession, d: str) -> DataFrame:
    width = F.greatest(F.lit(0.0), (F.col("end") - F.col("start")).cast("double"))
    return _questions(spark, d).select("conv_id", "turn", F.array_join(Q.selection_tags(F.col("question"), F.col("kind"), F.when(F.col("start").isNotNull(), width)), ",").alias("tags"))


REASONS = ("", "Planner_Provider_Exhausted", "Maximum context length reached", "context_overflow:", "visual structured response reached max_tokens", "Direct final contract exhausted", "shared: the contract exhausted", "HTTP 500 from", "service down", "contract exhausted", "disk full")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN '' ELSE (['', 'Planner_Provider_Exhausted', 'Maximum context length reached', 'context_overflow:', 'visual structured response reached max_tokens', 'Direct final contract exhausted', 'shared: the contract exhausted', 'HTTP 500 from', 'service down', 'contract exhausted', 'disk full'])[doc_id % 11 + 1] || ' ' || text END AS r FROM documents), l AS (SELECT doc_id, lower(r) AS r FROM r)
SELECT doc_id, CASE WHEN r = '' THEN NULL WHEN contains(r, 'planner_provider_exhausted') THEN 'planner_provider_exhausted' WHEN contains(r, 'maximum context length') OR contains(r, 'context_overflow') THEN 'downstream_local_context_overflow'
 WHEN contains(r, 'visual structured response reached max_tokens') THEN 'fine_visual_max_tokens_or_validation_exhaustion' WHEN contains(r, 'direct final contract exhausted') THEN 'final_contract_exhaustion' WHEN contains(r, 'shared') AND contains(r, 'contract exhausted') THEN 'shared_contract_exhaustion'
 WHEN contains(r, 'provider') OR contains(r, 'http') OR contains(r, 'service') THEN 'provider_service_runtime_error' ELSE 'other_evidenced_failure' END AS failure FROM l""")
def failure_classify(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules over whole logs: a message before each document."""
    i = F.col("doc_id")
    message = F.get(F.array(*map(F.lit, REASONS)), (i % len(REASONS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", Q.failure_class(F.when(i % 12 == 0, "").otherwise(F.concat_ws(" ", message, "text"))).alias("failure"))


def _cue_text(i, u, word):
    """Sentences made of an event's numbers: ranges, times within and outside of them, seconds, relative words and quoted phrases."""
    m, text = i % 3600, lambda x: x.cast("string")
    two = lambda x: F.lpad(text(x), 2, "0")
    clock = lambda a, b: F.concat(text(a), F.lit(":"), two(b))
    more = F.when(i % 3 == 0, F.concat(F.lit(" or 1:0"), text(i % 10), F.lit(" - 2:1"), text(u % 10))).when(i % 3 == 1, F.concat(F.lit(" during the between "), text(i % 50), F.lit(".5 to "), text(i % 50 + 9), F.lit(" seconds"))).otherwise(F.concat(F.lit(" – "), clock(i % 7, u % 60)))
    return F.concat(F.lit("Between "), clock(m % 60, m % 59), F.lit(" and "), clock(m % 60 + 1, m % 60), more, F.lit(', before "'), word, F.lit(" "), text(u), F.lit('" at '), clock(u % 24, i % 60))


@query("""WITH e AS (SELECT event_id AS i, user_id AS u, event_id % 3600 AS m, event_type AS w FROM events), c AS (SELECT *, (m % 60) || ':' || lpad((m % 59)::VARCHAR, 2, '0') AS a, (m % 60 + 1) || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS b, (u % 24) || ':' || lpad((i % 60)::VARCHAR, 2, '0') AS z, (i % 7) || ':' || lpad((u % 60)::VARCHAR, 2, '0') AS y FROM e),
x AS (SELECT i, [CASE WHEN i % 3 = 0 THEN {'r': '1:0' || (i % 10) || ' - 2:1' || (u % 10), 't': 'explicit_time_range', 's': 60.0 + i % 10, 'e': 130.0 + u % 10} WHEN i % 3 = 2 THEN {'r': b || ' – ' || y, 't': 'explicit_time_range', 's': (m % 60 + 1) * 60.0 + m % 60, 'e': i % 7 * 60.0 + u % 60} END,
 {'r': 'Between ' || a || ' and ' || b, 't': 'explicit_time_range', 's': m % 60 * 60.0 + m % 59, 'e': (m % 60 + 1) * 60.0 + m % 60}, CASE WHEN i % 3 = 1 THEN {'r': 'between ' || (i % 50) || '.5 to ' || (i % 50 + 9) || ' seconds', 't': 'explicit_time_range', 's': i % 50 + 0.5, 'e': i % 50 + 9.0} END, {'r': z, 't': 'explicit_timestamp', 's': u % 24 * 60.0 + i % 60, 'e': u % 24 * 60.0 + i % 60}] AS l,
 'Between,' || CASE WHEN i % 3 = 1 THEN 'during,between,' ELSE '' END || 'before' AS relative, w || ' ' || u AS quoted FROM c)
SELECT i AS event_id, array_to_string(list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: x.r || '=' || x.t || '/' || printf('%.1f', x.s::DOUBLE) || '/' || printf('%.1f', x.e::DOUBLE)), '|') AS times, relative, quoted FROM x""")
def extract_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues with kinds and seconds; a time within a range is no cue of its own."""
    c = table(spark, d, "events").select("event_id", Q.cues(_cue_text(F.col("event_id"), F.col("user_id"), F.col("event_type"))).alias("c"))
    one = lambda x: F.concat(x["raw_text"], F.lit("="), x["cue_type"], F.lit("/"), F.format_string("%.1f", x["start_sec"]), F.lit("/"), F.format_string("%.1f", x["end_sec"]))
    return c.select(
        "event_id", F.array_join(F.transform("c.time_cues", one), "|").alias("times"), F.array_join("c.relative_temporal_expressions.raw_text", ",").alias("relative"), F.array_join("c.quoted_phrases.text", "|").alias("quoted")
    )


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS h FROM conversations")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.md5(Q.normalize_answer(F.col("text")).cast("binary")).alias("h"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (value::DECIMAL(12, 2))::VARCHAR WHEN 1 THEN (event_id % 90) || ':' || (event_id % 60) || ',5' WHEN 2 THEN (event_id % 9) || ':' || (event_id % 60) || ':' || (user_id % 60) || '.25' WHEN 3 THEN 't=' || (event_id % 90) || ':' || (user_id % 60) || ' s' ELSE event_type END AS s, value, user_id FROM events)
SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN (value::DECIMAL(12, 2))::DOUBLE WHEN 1 THEN (event_id % 90) * 60 + event_id % 60 + 0.5 WHEN 2 THEN (event_id % 9) * 3600 + (event_id % 60) * 60 + user_id % 60 + 0.25 WHEN 3 THEN (event_id % 90) * 60 + user_id % 60 ELSE 0 END::DOUBLE, 4) AS sec FROM e""")
def hhmmss_to_sec(spark: SparkSession, d: str) -> DataFrame:
    """One to three parts, comma or point, junk stripped, 0 for what is no time."""
    i, u = F.col("event_id"), F.col("user_id") % 60
    s = lambda x: x.cast("string")
    c = F.lit(":")
    t = (
        F.when(i % 5 == 0, s(F.col("value").cast("decimal(12,2)"))).when(i % 5 == 1, F.concat(s(i % 90), c, s(i % 60), F.lit(",5")))
        .when(i % 5 == 2, F.concat(s(i % 9), c, s(i % 60), c, s(u), F.lit(".25"))).when(i % 5 == 3, F.concat(F.lit("t="), s(i % 90), c, s(u), F.lit(" s"))).otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select("event_id", F.round(Q.clock_or_zero(t), 4).alias("sec"))


@query("""WITH e AS (SELECT event_id, (event_id % 60) AS a, (user_id % 60) AS b FROM events), s AS (SELECT *, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN a || ' to ' || b ELSE a || ':05' || CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN ' to ' ELSE ' – ' END || b || ':07' END AS s FROM e)
SELECT event_id, CASE WHEN event_id % 7 > 1 AND a <= b THEN a * 60.0 + 5 END::DOUBLE AS start_sec, CASE WHEN event_id % 7 > 1 AND a <= b THEN b * 60.0 + 7 END::DOUBLE AS end_sec, CASE WHEN event_id % 7 = 0 OR event_id % 7 > 1 AND a <= b THEN '' WHEN event_id % 7 = 1 THEN 'unparsed_provided_timestamp:' || s ELSE 'invalid_provided_timestamp:' || s END AS warnings FROM s""")
def parse_time_range(spark: SparkSession, d: str) -> DataFrame:
    i, a, b = F.col("event_id"), (F.col("event_id") % 60).cast("string"), (F.col("user_id") % 60).cast("string")
    dash = F.when(i % 3 == 0, "-").when(i % 3 == 1, " to ").otherwise(" – ")
    s = F.when(i % 7 == 0, "").when(i % 7 == 1, F.concat(a, F.lit(" to "), b)).otherwise(F.concat(a, F.lit(":05"), dash, b, F.lit(":07")))
    x = table(spark, d, "events").select("event_id", Q.time_range(s).alias("r"))
    return x.select("event_id", "r.start_sec", "r.end_sec", F.array_join("r.warnings", ";").alias("warnings"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 <> 3 AS ok FROM events")
def parse_model_json(spark: SparkSession, d: str) -> DataFrame:
    """Plain, within a fence, with blanks around, and a list, which is no object."""
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit(" \n"), p, F.lit(" "))).otherwise(F.concat(F.lit("["), p, F.lit("]")))
    m = Q.model_json(raw, "k long")
    return table(spark, d, "events").select("event_id", m["k"].alias("k"), m.isNotNull().alias("ok"))


_PLAN = {
    "answer_requirement": '{"operation": "count_occurrences", "description": "%s"}', "anchor_cues": '[{"text": "%s", "modality": "time"}]', "primary_anchor_modality": '"speech"', "resolver_modalities": '["speech", "visual"]', "audio_role": '"direct_answer"',
    "temporal_relation": '"during"', "requires_local_visual_inspection": "false", "visual_route": '"not_required"', "fallback_route": '"%s"', "planner_confidence": "0.5", "rationale": '"One. Two."',
}
#: What goes wrong in a plan, by number: the field, and its value instead (none: the field goes).
_SPOILT = (
    ("rationale", None), ("extra", "1"), ("answer_requirement", "[]"), ("answer_requirement", '{"operation": "guess", "description": " "}'), ("anchor_cues", "{}"), ("anchor_cues", '[{"text": 1, "modality": "time"}, 2, {"text": "a", "modality": "visual"}]'),
    ("primary_anchor_modality", '"all"'), ("resolver_modalities", '["speech", "speech"]'), ("audio_role", "1"), ("temporal_relation", "null"), ("requires_local_visual_inspection", '"true"'), ("visual_route", '""'), ("fallback_route", '" "'), ("planner_confidence", "true"),
    ("planner_confidence", "1.5"), ("rationale", '"A. B! C?"'), ("rationale", '" "'),
)


@query("""SELECT doc_id, CASE WHEN doc_id % 19 = 18 THEN 'top-level JSON must be an object' ELSE coalesce((['missing field: rationale; rationale must be non-empty text', 'unexpected field: extra', 'answer_requirement must contain exactly operation and description',
 'invalid answer_requirement.operation; answer_requirement.description must be non-empty text', 'anchor_cues must be a list', 'anchor_cues[0] has invalid values; anchor_cues[1] has invalid structure', 'invalid primary_anchor_modality', 'resolver_modalities must be a unique valid list', 'invalid audio_role', 'invalid temporal_relation',
 'requires_local_visual_inspection must be boolean', 'invalid visual_route', 'fallback_route must be non-empty text', 'planner_confidence must be between 0 and 1', 'planner_confidence must be between 0 and 1', 'rationale must contain at most two sentences', 'rationale must be non-empty text'])[doc_id % 19], '') END AS errors FROM documents""")
def validate_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each document, with its words in the free texts: right ones, ones with a fault of each kind, and ones that are cut off."""
    word = F.regexp_replace(F.concat_ws("-", "lang", "source"), r'["\\]', "")

    def plan(field: str = "", value: str | None = None):
        parts = {k: v for k, v in (_PLAN | {field: value}).items() if v is not None}
        pieces = ("{" + ", ".join(f'"{k}": {v}' for k, v in parts.items()) + "}").split("%s")
        return F.concat(*[c for i, x in enumerate(pieces) for c in ([word] if i else []) + [F.lit(x)]])

    i = F.col("doc_id") % 19
    raw = F.when(i == 0, plan()).when(i == 18, F.substring(plan(), 1, 40))
    for n, (field, value) in enumerate(_SPOILT, 1):
        raw = raw.when(i == n, plan(field, value))
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.plan_errors(raw), "; ").alias("errors"))


@query("SELECT event_id, CASE WHEN event_id % 300 <= 256 AND (user_id * 7) % 28 = 0 THEN (event_id % 300) * ((user_id * 7 // 28) ** 2)::BIGINT END AS tokens FROM events")
def visual_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", Q.visual_tokens(F.col("event_id") % 300, F.col("user_id") * 7).alias("tokens"))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), c AS (SELECT n_nationkey AS k, n_name || ' ' || coalesce(string_agg(c_mktsegment, ' ' ORDER BY c_custkey), '') || ' ' || '' AS t, list_distinct(list(trim(c_mktsegment) ORDER BY c_custkey)) AS e FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)
SELECT k, md5(t) AS coarse FROM c""")
def coarse_text(spark: SparkSession, d: str) -> DataFrame:
    """A node's summary with its lists of entities and of places (none here)."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: x["c_mktsegment"]).alias("e"))
    j = table(spark, d, "nation").join(c, "n_nationkey", "left")
    return j.select(F.col("n_nationkey").alias("k"), F.md5(Q.coarse_text(F.col("n_name"), F.col("e"), F.array().cast("array<string>")).cast("binary")).alias("coarse"))


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'n' || event_id % 5 WHEN event_id % 4 = 2 THEN 'v' || event_id % 3 END AS t FROM events), f AS (SELECT user_id, t, min(event_id) AS f FROM x WHERE t IS NOT NULL GROUP BY ALL)
SELECT user_id, string_agg(t, ',' ORDER BY f) AS texts FROM f GROUP BY user_id""")
def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    """Items with a text, with a name alone, plain ones and empty ones."""
    i = F.col("event_id")
    item = F.struct(
        F.when(i % 4 == 0, F.col("event_type")).when(i % 4 == 3, " ").alias("text"), F.when(i % 4 == 1, F.concat(F.lit(" n"), (i % 5).cast("string"))).alias("name"), F.when(i % 4 == 2, F.concat(F.lit("v"), (i % 3).cast("string"))).alias("value"),
    )
    g = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda y: y["x"]).alias("items"))
    return g.select("user_id", F.array_join(Q.entity_texts(F.col("items")), ",").alias("texts")).where("texts <> ''")


@query("""WITH e AS (SELECT event_id, event_id % 50 AS a, user_id % 50 AS b FROM events) SELECT event_id, 0 AS i, (a * 60 + 5)::DOUBLE AS start_sec, (b * 60 + 59)::DOUBLE AS end_sec FROM e WHERE a * 60 + 5 <= b * 60 + 59
UNION ALL SELECT event_id, CASE WHEN a * 60 + 5 <= b * 60 + 59 THEN 1 ELSE 0 END, (3600 + a)::DOUBLE, (7200 + b)::DOUBLE FROM e WHERE event_id % 3 <> 0""")
def text_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans that a sentence names by clock times."""
    i, a, b = F.col("event_id"), F.col("event_id") % 50, F.col("user_id") % 50
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    more = F.when(i % 3 != 0, F.concat(F.lit(" then 1:00:"), two(a), F.lit(" to 02:00:"), two(b))).otherwise("")
    s = F.concat(F.lit("look at "), a.cast("string"), F.lit(":05-"), b.cast("string"), F.lit(":59"), more, F.lit(" please"))
    return table(spark, d, "events").select("event_id", F.posexplode(Q.text_spans(s, 8)).alias("i", "x")).select("event_id", "i", "x.start_sec", "x.end_sec")


@query(f"""WITH {IV}, n AS (SELECT video_id, count(*) AS n FROM iv GROUP BY 1), m0 AS (SELECT *, max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
u AS (SELECT video_id, sum(greatest(0, end_sec - greatest(start_sec, coalesce(pm, start_sec)))) AS seconds FROM m0 GROUP BY 1), o AS (SELECT video_id, n, seconds, array_to_string(list_filter([CASE WHEN n > 7 THEN 'count' END, CASE WHEN seconds > 72000 THEN 'seconds' END], lambda x: x IS NOT NULL), ',') AS over FROM n JOIN u USING (video_id)) SELECT * FROM o WHERE over <> ''""")
def budget_check(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evidence import budget_violations

    return budget_violations(intervals(spark, d), "video_id", 7, 72_000.0)


# -- filters, options, unions ---------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND n_chars % 11 > n_chars % 7")
def validity_filters(spark: SparkSession, d: str) -> DataFrame:
    """Segments with a text and an end after their start."""
    x = table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") % 7).alias("start_sec"), (F.col("n_chars") % 11).alias("end_sec"))
    return S.valid_segments(x).select("doc_id")


@query("SELECT vec_id, vec_id % 9 <> 4 AND vec_id % 9 <> 7 AS fine FROM embeddings")
def finite_check(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a component that is no number or endless are found."""
    i, e = F.col("vec_id") % 9, F.col("embedding").cast("array<double>")
    bad = F.when(i == 4, F.concat(e, F.array(F.lit(float("nan"))))).when(i == 7, F.concat(e, F.array(F.lit(float("-inf"))))).otherwise(e)
    return table(spark, d, "embeddings").select("vec_id", V.finite(bad).alias("fine"))


@query("""WITH s AS (SELECT l_orderkey AS video_id, l_linenumber % 3 AS frame, l_linenumber AS t, [l_partkey % 7, l_suppkey % 7, (l_partkey + l_suppkey) % 7, l_quantity::BIGINT % 7, l_partkey * 3 % 7]::DOUBLE[] AS v FROM lineitem),
b AS (SELECT *, list_max(v) AS score, chr(64 + list_position(v, list_max(v))::INTEGER) AS option FROM s)
SELECT video_id, frame, score, option, t FROM b QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, t, option) = 1""")
def option_max(spark: SparkSession, d: str) -> DataFrame:
    """The best of five options' scores with the first label on ties; then the best row of each frame."""
    l = table(spark, d, "lineitem")
    parts = {"A": F.col("l_partkey") % 7, "B": F.col("l_suppkey") % 7, "C": (F.col("l_partkey") + F.col("l_suppkey")) % 7, "D": F.col("l_quantity").cast("long") % 7, "E": F.col("l_partkey") * 3 % 7}
    score, option = Q.best_option({k: c.cast("double") for k, c in parts.items()})
    x = l.select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") % 3).alias("frame"), F.col("l_linenumber").alias("t"), score.alias("score"), option.alias("option"))
    best = x.groupBy("video_id", "frame").agg(F.min(F.struct((-F.col("score")).alias("z"), "t", "score", "option")).alias("b"))
    return best.select("video_id", "frame", "b.score", "b.option", "b.t")


@query("SELECT item_id AS id, 'text' AS channel, text AS body FROM benchmark UNION ALL SELECT vec_id, 'vector', NULL FROM embeddings UNION ALL SELECT page_id, 'page', url FROM pages")
def union_append(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several channels one after the other; repeated ones stay."""
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("text").alias("channel"), F.col("text").alias("body"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vector").alias("channel"))
    c = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("channel"), F.col("url").alias("body"))
    return S.union_of_columns(S.union_of_columns(a, b), c)


@query(f"WITH {AT} SELECT status, count(*) AS n, sum(tokens)::BIGINT AS tokens, round(sum(elapsed_sec) / 3600, 6) AS hours, count(*) FILTER (WHERE status = 'success' AND regexp_matches(pred, '^[A-E]$')) AS strict FROM att GROUP BY status")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts, tokens and hours by status."""
    from ..operators.evaluate import strict_complete

    g = attempts(spark, d).groupBy("status")
    return g.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("elapsed_sec") / 3600, 6).alias("hours"), F.count(F.when(strict_complete(), 1)).alias("strict"))


_H = "sha256(concat('review-1', chr(0), uid))"


@query(f"""WITH {AT}, f AS (SELECT uid, status, pred, gold, elapsed_sec, {_H} AS h FROM att WHERE attempt = 0), a AS (SELECT uid FROM f WHERE status = 'success' AND pred = gold ORDER BY h, uid LIMIT 20), b AS (SELECT uid FROM f WHERE status = 'success' AND uid NOT IN (SELECT uid FROM a) ORDER BY h, uid LIMIT 10), c AS (SELECT uid FROM f WHERE elapsed_sec > 100 AND uid NOT IN (SELECT uid FROM a UNION ALL SELECT uid FROM b) ORDER BY h, uid LIMIT 5)
SELECT uid, 'right' AS bucket FROM a UNION ALL SELECT uid, 'completed' FROM b UNION ALL SELECT uid, 'slow' FROM c""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """Quotas of a review, in order; no row is in two of them."""
    x = attempts(spark, d).where("attempt = 0")
    done = F.col("status") == "success"
    return G.review_samples(x, "uid", [("right", done & (F.col("pred") == F.col("gold")), 20), ("completed", done, 10), ("slow", F.col("elapsed_sec") > 100, 5)], "review-1")


# How many cases of each kind a selection has.
QUOTAS = {Q.SOUND_SOURCE: 4, Q.SOUND: 3, Q.CROSS_MODAL: 4, Q.COUNTING: 3, Q.TEMPORAL: 2, Q.SPATIAL: 2, Q.CAUSAL: 2}
#: Kinds of which wide spans are preferred.
WIDE = (Q.COUNTING, Q.TEMPORAL)


def stratified_cases(spark: SparkSession, d: str) -> DataFrame:
    q, kind = F.col("question"), F.col("kind")
    m = _questions(spark, d).withColumn("m", Q.temporal_metadata(q, F.col("start"), F.col("end")))
    return m.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), kind.alias("type"), F.col("m.hint").alias("hint"), Q.selection_tags(q, kind, F.col("m.width_sec")).alias("tags"), F.col("conv_id").alias("video_id"), F.col("m.width_sec").alias("width")
    )


@query()
def greedy_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Quotas of kinds on top of the first two conversations' opening cases, balanced over hints, tags and conversations; tested against picks over all rows."""
    cases = stratified_cases(spark, d)
    return G.greedy_stratified(cases, QUOTAS, earlier=cases.where("case_id in (0, 1000)"), total=sum(QUOTAS.values()), wide=WIDE)


# -- ledgers and resumed work -------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS account, o_orderkey // 2 AS charge_id, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(amount) OVER (PARTITION BY account ORDER BY seq) AS spent FROM o)
SELECT account, charge_id, round(spent, 4) AS spent, spent <= 300000 AS within FROM r""")
def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Each charge once, the running sum of its account, and whether that is within the budget."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.expr("o_orderkey div 2").alias("charge_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"))
    l = L.ledger(o, "account", "charge_id", "seq", "amount", 300_000.0)
    return l.select("account", "charge_id", F.round("spent", 4).alias("spent"), "within")


@query("SELECT item_id, length(text) AS n, item_id % 3 <> 0 AS resumed FROM benchmark")
def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cases is done already; only the others are worked on."""
    path = f"{S.work_dir(spark)}/quillon/resume-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark").select("item_id", "text")
    work = lambda resumed: lambda x: x.select("item_id", F.char_length("text").cast("long").alias("n"), F.lit(resumed).alias("resumed"))
    S.resume(spark, b.where("item_id % 3 = 0"), path, "item_id", work(False))
    return S.resume(spark, b, path, "item_id", work(True))


# -- manifests ----------------------------------------------------------------------------


@query("""WITH r AS (SELECT vec_id AS o, sha256(vec_id || '|' || label || '|' || len(embedding)) AS h FROM embeddings), b AS (SELECT o // 1000 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM r GROUP BY 1), c AS (SELECT o // 1000 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM b GROUP BY 1), t AS (SELECT sha256(string_agg(h, '' ORDER BY o)) AS content FROM c),
s AS (SELECT sha256('embedding' || chr(10) || 'label' || chr(10) || 'vec_id') AS schema) SELECT (SELECT count(*) FROM embeddings) AS rows, schema, content, sha256('content=' || content || chr(10) || 'model=m1' || chr(10) || 'rows=' || (SELECT count(*) FROM embeddings) || chr(10) || 'schema=' || schema) AS run FROM t, s""")
def run_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """With schema_hash: a table's fields, rows and contents, and the parts of a run by name."""
    e = table(spark, d, "embeddings")
    return L.table_fingerprint(e, "vec_id", F.concat_ws("|", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.size("embedding").cast("string")), model="m1")


@query("SELECT item_id, CASE WHEN item_id % 5 = 1 THEN 'changed' WHEN item_id % 5 = 2 THEN 'missing' WHEN item_id % 5 = 3 THEN 'unexpected' END AS state FROM benchmark WHERE item_id % 5 IN (1, 2, 3)")
def verify_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files written and hashed, then held against a manifest with other hashes, further files and left-out ones."""
    path = f"{S.work_dir(spark)}/quillon/tree-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark").select("item_id", "text")
    b.where("item_id % 5 <> 2").select(F.col("text").alias("value"), "item_id").write.partitionBy("item_id").text(path)
    own = L.manifest_of(spark, path).withColumn("path", F.regexp_extract("path", r"item_id=(\d+)/", 1))
    raw = F.concat(F.col("text"), F.lit("\n")).cast("binary")
    sha = F.sha2(F.when(F.col("item_id") % 5 == 1, F.concat(raw, F.lit("x").cast("binary"))).otherwise(raw), 256)
    want = b.where("item_id % 5 <> 3").select(F.col("item_id").cast("string").alias("path"), F.octet_length(raw).cast("long").alias("bytes"), sha.alias("sha"))
    return L.verify(want, own).select(F.col("path").cast("long").alias("item_id"), "state")


# -- metrics and backends ------------------------------------------------------------------


@query(r"""WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT * FROM c WHERE b IS NOT NULL)
SELECT conv_id, turn, 'exact_match' AS metric, (trim(a) = trim(b))::INTEGER::DOUBLE AS value, true AS available, NULL AS error FROM p UNION ALL
SELECT conv_id, turn, 'normalized_exact_match', (trim(regexp_replace(lower(a), '[^\p{L}\p{N}_]+', ' ', 'g')) = trim(regexp_replace(lower(b), '[^\p{L}\p{N}_]+', ' ', 'g')))::INTEGER::DOUBLE, true, NULL FROM p UNION ALL
SELECT conv_id, turn, 'llm_judge', NULL, false, NULL FROM p UNION ALL SELECT conv_id, turn, 'broken', NULL, false, 'AnalysisException' FROM p""")
def metric_registry(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics, one that isn't available and one whose column doesn't exist."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = _turns(spark, d).withColumn("b", F.lead("text").over(w)).where("b is not null").select("conv_id", "turn", F.col("text").alias("a"), "b")
    m = G.Metrics(
        G.Metric("exact_match", "overlap", lambda x: (F.trim("a") == F.trim("b")).cast("int")),
        G.Metric("normalized_exact_match", "overlap", lambda x: (Q.normalize_answer(F.col("a")) == Q.normalize_answer(F.col("b"))).cast("int")),
        G.Metric("llm_judge", "judge", None),
        G.Metric("broken", "overlap", lambda x: F.col("no_such_column")),
    )
    return m.evaluate(p, ["conv_id", "turn"]).drop("category")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries of the benchmark with the vector of their number, and documents with the vector of theirs."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").alias("group"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text").join(v.drop("group"), "doc_id").withColumnRenamed("doc_id", "query_id")
    return q, table(spark, d, "documents").select("doc_id", "text").join(v, "doc_id")


def _backend(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.retrieve(*_index(spark, d), backend=name, k=5)

    return run


_IX = "x AS (SELECT doc_id, text, embedding::DOUBLE[] AS v, label FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"
_TOP = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5"


@query(f"WITH {_IX}, s AS (SELECT query_id, doc_id, list_cosine_similarity(v, q) AS score FROM q, x) {_TOP}")
def retrieve_embed(spark: SparkSession, d: str) -> DataFrame:
    return _backend("embed")(spark, d)


@query(f"""WITH {_IX}, m AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x) GROUP BY ALL), p AS (SELECT label, list(m ORDER BY i) AS pv FROM m GROUP BY label),
g AS (SELECT query_id, label FROM q, p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(pv, q) DESC, label) <= 3), s AS (SELECT q.query_id, x.doc_id, list_cosine_similarity(v, q) AS score FROM q JOIN g USING (query_id) JOIN x USING (label)) {_TOP}""")
def retrieve_dense(spark: SparkSession, d: str) -> DataFrame:
    """Three groups by their mean vectors, then their rows alone."""
    return _backend("dense")(spark, d)


@query(f"WITH {_IX}, s AS (SELECT query_id, doc_id, list_dot_product(v, q) AS score FROM q, x) {_TOP}")
def retrieve_flat(spark: SparkSession, d: str) -> DataFrame:
    return _backend("flat")(spark, d)


_BM = """tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM x), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk), tf AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM tk) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS t FROM q),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (t) JOIN df USING (t), st GROUP BY 1, 2)"""


@query(f"WITH {_IX}, {_BM}, s AS (SELECT * FROM bm WHERE score > 0) {_TOP}")
def retrieve_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _backend("bm25")(spark, d)


@query(f"""WITH {_IX}, {_BM}, e AS (SELECT query_id, doc_id, list_cosine_similarity(v, q) AS score FROM q, x), sc AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS a FROM e WINDOW w AS (PARTITION BY query_id)),
sb AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS b FROM bm WHERE score > 0 WINDOW w AS (PARTITION BY query_id)), s AS (SELECT query_id, doc_id, 0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0) AS score FROM sc FULL JOIN sb USING (query_id, doc_id)) {_TOP}""")
def retrieve_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Both lists scaled to one range, and summed."""
    return _backend("weighted")(spark, d)


@query(f"WITH {_IX}, e AS (SELECT query_id, doc_id, round(list_cosine_similarity(v, q), 6) AS score FROM q, x), s AS (SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score FROM e GROUP BY query_id, doc_id // 3) {_TOP}")
def retrieve_siglip(spark: SparkSession, d: str) -> DataFrame:
    """The best frame of every second (here three rows), then the best seconds."""
    return _backend("siglip")(spark, d)


@query(f"""WITH RECURSIVE {_IX}, m AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x) GROUP BY ALL), p AS (SELECT label, list(m ORDER BY i) AS pv FROM m GROUP BY label),
gt AS (SELECT query_id, label FROM q, p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(pv, q) DESC, label) <= 3), f AS (SELECT q.query_id, x.doc_id, round(list_cosine_similarity(v, q), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(v, q), 6) DESC, x.doc_id) AS i FROM q JOIN gt USING (query_id) JOIN x USING (label)),
g AS (SELECT query_id, i, [doc_id] AS taken FROM f WHERE i = 1 UNION ALL SELECT f.query_id, f.i, CASE WHEN len(taken) < 5 AND len(list_filter(taken, lambda y: abs(y - f.doc_id) < 4)) = 0 THEN list_append(taken, f.doc_id) ELSE taken END FROM g JOIN f ON f.query_id = g.query_id AND f.i = g.i + 1),
t AS (SELECT query_id, arg_max(taken, i) AS taken FROM g GROUP BY query_id), r AS (SELECT t.query_id, list(f.doc_id ORDER BY f.i) AS rest FROM t JOIN f ON f.query_id = t.query_id WHERE NOT list_contains(taken, f.doc_id) GROUP BY t.query_id), k AS (SELECT t.query_id, unnest(list_concat(taken, list_slice(coalesce(rest, []), 1, greatest(0, 5 - len(taken))))) AS doc_id FROM t LEFT JOIN r USING (query_id)),
s AS (SELECT query_id, doc_id, score FROM k JOIN f USING (query_id, doc_id)) {_TOP}""")
def retrieve_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """The best groups, then rows in them that are apart, filled up with the next best."""
    return _backend("hierarchical")(spark, d)


@query("""WITH e AS (SELECT user_id, event_id, (event_id % 40)::DOUBLE AS s, (event_id % 40 + user_id % 7)::DOUBLE AS e FROM events), x AS (SELECT event_id, 0 AS span, s AS a, e AS b FROM e UNION ALL SELECT event_id, 1, s + 3, e + 4 FROM e), m AS (SELECT event_id, span, unnest(range(0, ceil((b - a) / 2.0)::INTEGER)) AS n, a FROM x WHERE a < b),
f AS (SELECT event_id, span, a + n * 2.0 AS moment FROM m), u AS (SELECT *, row_number() OVER (PARTITION BY event_id, moment ORDER BY span) AS r FROM f) SELECT event_id, span, moment FROM u WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY span, moment) <= 5""")
def visual_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Moments of spans by a table function in SQL, joined laterally."""
    from ..functions import tables

    tables.register(spark)
    view = f"spans_{uuid.uuid4().hex}"
    span = lambda a, b: F.struct(a.cast("double").alias("start_sec"), b.cast("double").alias("end_sec"))
    s, e = F.col("event_id") % 40, F.col("event_id") % 40 + F.col("user_id") % 7
    table(spark, d, "events").select("event_id", F.array(span(s, e), span(s + 3, e + 4)).alias("spans")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT event_id, span, moment FROM {view}, LATERAL visual_inspect(spans, 2.0D, 5)")


# -- signals and arrays from files -----------------------------------------------------------


@query()
def acoustic_features(spark: SparkSession, d: str) -> DataFrame:
    """RMS, spectral flux and log change of a user's values as a signal; tested against a plain version."""
    e = Ordered(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    samples = e.running("i", F.lit(1).cast("long"), "sum", inclusive=True).rows().select("user_id", (F.col("i") - 1).alias("i"), "value")
    return acoustic(samples, "user_id", 40, 1.0, 0.25, 1.0)


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS sq, len(embedding)::INTEGER AS n FROM embeddings")
def scan_npy(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through files of arrays, read in ranges of rows; ids are the first column."""
    path = f"{S.work_dir(spark)}/quillon/npy-{uuid.uuid4().hex}"
    A.write_arrays(table(spark, d, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("vec")), path)
    v = A.read_arrays(spark, path, part_bytes=256 << 10).select(F.get("vec", F.lit(0)).cast("long").alias("vec_id"), F.slice("vec", 2, 1 << 20).alias("e"))
    return v.select("vec_id", F.round(V.dot(F.col("e"), F.col("e")), 5).alias("sq"), F.size("e").alias("n"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def sink_json_atomic(spark: SparkSession, d: str) -> DataFrame:
    """One object a file under its final name only when it is whole; a second write replaces it at once."""
    path = f"{S.work_dir(spark)}/quillon/atomic-{uuid.uuid4().hex}"
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    for version in ("old", "new"):
        write_json_atomic(rows.withColumn("name", F.when(F.lit(version == "new"), F.col("name")).otherwise("old")), path, "k")
    return spark.read.schema("k int, name string").json(f"{path}/*.json")


# The rule's forms in SQL: blanks of any kind go from the ends, letters are folded (not only lower-cased). DuckDB composes, but knows no compatibility forms.
_EVERY = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
_BLANKS = "||".join(f"chr({ord(c)})" for c in _EVERY if c.isspace())
_FOLDS = {c.lower(): c.casefold() for c in _EVERY if c.casefold() != c.lower() and len(c.lower()) == 1 and unicodedata.normalize("NFKC", c) == c}


def _own(col: str) -> str:
    return f"trim(nfc_normalize(coalesce({col}, '')), {_BLANKS})"


def _folded(own: str) -> str:
    one = {c: f for c, f in _FOLDS.items() if len(f) == 1}
    out = f"translate(lower({own}), '{''.join(one)}', '{''.join(one.values())}')"
    for c, f in _FOLDS.items():
        out = out if len(f) == 1 else f"replace({out}, '{c}', '{f}')"
    return out


def _forms_sql(key: str, texts: str) -> str:
    """Rows (key, o, f, p): a text as it is, folded, and its letters alone."""
    plain = r"trim(regexp_replace(f, '[^\p{L}\p{N}]+', ' ', 'g'))"
    return f"SELECT {key}, o, f, {plain} AS p FROM (SELECT *, {_folded('o')} AS f FROM (SELECT {key}, {_own('text')} AS o FROM {texts}))"


@query(f"""WITH t AS ({_forms_sql('doc_id', 'documents')}), b AS ({_forms_sql('item_id', 'benchmark')}),
m AS (SELECT doc_id, item_id, CASE WHEN contains(t.o, b.o) THEN 'unicode_normalized_exact' WHEN contains(t.f, b.f) THEN 'case_insensitive' ELSE 'punctuation_insensitive' END AS method FROM t, b WHERE contains(t.o, b.o) OR contains(t.f, b.f) OR (b.p <> '' AND contains(t.p, b.p))),
s AS (SELECT *, CASE method WHEN 'unicode_normalized_exact' THEN 1.0 WHEN 'case_insensitive' THEN 0.98 ELSE 0.95 END::DOUBLE AS score, count(*) OVER (PARTITION BY item_id) AS n_matches FROM m)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS position, CASE WHEN n_matches > 1 THEN 'multiple_possible_matches' END AS ambiguity_warning FROM s""")
def phrase_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Every whole phrase in every whole text: exact, then case, then punctuation; with the number and order of each phrase's matches."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("phrase"))
    found = P.contained(R.balanced(table(spark, d, "documents").select("doc_id", "text")), b)
    return P.with_ambiguity(found, ["k"], F.col("doc_id")).withColumnRenamed("k", "item_id")


@query()
def phrase_ladder_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """All four rungs of every phrase against every turn of a conversation; 0.6 or more of the sequence matcher's ratio counts last."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("phrase"))
    t = _turns(spark, d).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    # and every phrase itself as it may be heard: without one of its commonest letters
    t = t.unionByName(b.select((-1 - F.col("k")).alias("doc_id"), F.translate("phrase", "e", "").alias("text")))
    return P.with_ambiguity(P.laddered(R.balanced(t), b), ["k"], F.col("doc_id"))
