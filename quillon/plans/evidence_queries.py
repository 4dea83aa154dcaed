"""Queries over evidence: roles, relations, contracts, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import lineage as L
from .fixtures import AT, IV, attempts, intervals, table
from .registry import query


@query(f"WITH {IV} SELECT id, array_to_string(list_filter([CASE WHEN modality = 'click' THEN 'trigger' END, CASE WHEN modality = 'view' THEN 'response' END, CASE WHEN value > 50 THEN 'anchor' END, CASE WHEN modality NOT IN ('click', 'view') THEN 'supporting' END], lambda x: x IS NOT NULL), ',') AS roles FROM iv")
def assign_roles(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", F.array_join(E.roles("modality", "value"), ",").alias("roles"))


_REL = f"""{IV}, p AS (SELECT a.id AS ai, b.id AS bi, a.modality AS am, b.modality AS bm, a.start_sec AS s, a.end_sec AS e, b.start_sec AS s2, b.end_sec AS e2, greatest(0.0, b.start_sec - a.end_sec, a.start_sec - b.end_sec) AS gap
 FROM iv a JOIN iv b ON a.video_id = b.video_id AND a.id <> b.id AND b.start_sec < a.end_sec + 7200 AND b.end_sec > a.start_sec - 7200),
resp AS (SELECT ai AS source_id, bi AS target_id, 'response_to' AS relation_type, gap FROM p WHERE am = 'view' AND bm = 'click' AND s >= e2),
rel AS (SELECT * FROM resp UNION ALL SELECT x.source_id, y.source_id, 'alternative_to', min(abs(x.gap - y.gap)) FROM resp x JOIN resp y ON x.target_id = y.target_id AND x.source_id < y.source_id GROUP BY 1, 2
 UNION ALL SELECT ai, bi, CASE WHEN s < e2 AND e > s2 THEN 'overlaps' ELSE 'near' END, gap FROM p WHERE ai < bi)"""


@query(f"WITH {_REL} SELECT * FROM rel")
def build_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.relations(intervals(spark, d))


@query(f"""WITH {IV}, p AS (SELECT a.id AS ai, r.id AS ri, a.video_id % 2 = 0 AS same, a.start_sec < r.end_sec AND a.end_sec > r.start_sec AS ov, greatest(0.0, r.start_sec - a.end_sec, a.start_sec - r.end_sec) AS gap FROM iv a JOIN iv r ON a.video_id = r.video_id AND a.id <> r.id AND r.start_sec < a.end_sec + 7200 AND r.end_sec > a.start_sec - 7200
 WHERE a.value > 50 AND r.modality IN ('purchase', 'signup'))
SELECT ai AS source_id, ri AS target_id, CASE WHEN ov THEN 'overlaps' ELSE 'near' END AS relation_type, gap FROM p UNION ALL SELECT ri, ai, 'resolves', gap FROM p WHERE same UNION ALL SELECT id, -1, 'fallback_recovery_for', 0.0 FROM iv WHERE modality = 'error'""")
def resolver_relations(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and resolvers, and what fallbacks recovered."""
    iv = intervals(spark, d).withColumn("same", F.col("video_id") % 2 == 0)
    r = E.resolver_relations(iv.where("value > 50"), iv.where("modality in ('purchase', 'signup')"), "same")
    return r.unionByName(E.fallback_relations(iv, F.col("modality") == "error"))


@query(f"WITH {_REL} SELECT relation_type, count(*) AS n FROM (SELECT relation_type FROM rel UNION ALL SELECT 'trigger_of' FROM rel WHERE relation_type = 'response_to') GROUP BY 1")
def invert_relations(spark: SparkSession, d: str) -> DataFrame:
    """With relation_counts."""
    return E.inverted(E.relations(intervals(spark, d))).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"WITH {_REL}, k AS (SELECT id FROM iv WHERE value > 10), r2 AS (SELECT * FROM rel UNION ALL SELECT * FROM rel WHERE source_id % 5 = 0), t AS (SELECT *, source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k) AS ok FROM r2) SELECT relation_type, 'kept' AS state, count(DISTINCT (source_id, target_id, round(gap, 9))) AS n FROM t WHERE ok GROUP BY 1 UNION ALL SELECT relation_type, 'dangling', count(*) FROM t WHERE NOT ok GROUP BY 1")
def stabilise_relations(spark: SparkSession, d: str) -> DataFrame:
    iv = intervals(spark, d)
    r = E.relations(iv)
    ok, bad = E.stable(r.unionByName(r.where("source_id % 5 = 0")), iv.where("value > 10"))
    n = lambda x, s: x.groupBy("relation_type").agg(F.count("*").alias("n")).select("relation_type", F.lit(s).alias("state"), "n")
    return n(ok, "kept").unionByName(n(bad, "dangling"))


@query(f"""WITH {IV}, g AS (SELECT video_id, bool_or(modality = 'click') AS t, bool_or(modality = 'view') AS r, bool_or(value > 90) AS strong, count(*) AS n FROM iv GROUP BY video_id)
SELECT video_id, CASE WHEN t AND r AND strong AND n >= 3 THEN 'sufficient' WHEN t AND r THEN 'questionable' ELSE 'insufficient' END AS status,
 array_to_string(list_filter([CASE WHEN NOT t THEN 'no_trigger' END, CASE WHEN NOT r THEN 'no_response' END, CASE WHEN NOT strong THEN 'weak_scores' END, CASE WHEN n < 3 THEN 'few' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def classify_evidence(spark: SparkSession, d: str) -> DataFrame:
    return E.sufficiency(intervals(spark, d))


@query(f"WITH {IV}, g AS (SELECT id FROM iv WHERE value > 20 UNION ALL SELECT id FROM iv WHERE value > 95), r AS (SELECT id FROM iv WHERE value > 15 AND value < 99), n AS (SELECT id, count(*) AS n FROM g GROUP BY id) SELECT coalesce(r.id, n.id) AS id, CASE WHEN r.id IS NULL THEN 'not_retained' WHEN n.n IS NULL THEN 'ungrouped' ELSE 'several' END AS violation FROM r FULL JOIN n ON r.id = n.id WHERE r.id IS NULL OR n.n IS NULL OR n.n > 1")
def group_membership(spark: SparkSession, d: str) -> DataFrame:
    iv = intervals(spark, d).select("id", "value")
    g = iv.where("value > 20").select("id").unionByName(iv.where("value > 95").select("id"))
    return E.group_violations(g, iv.where("value > 15 and value < 99"))


@query(f"WITH {IV}, w AS (SELECT video_id, id, modality, value, start_sec FROM iv QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY value DESC, id) <= 6) SELECT video_id, CASE WHEN count(*) FILTER (WHERE modality = 'click') > 0 AND count(*) FILTER (WHERE modality = 'view') > 0 THEN 'causal' WHEN count(DISTINCT modality) = 1 THEN 'single' ELSE 'mixed' END AS group_type, arg_max(id, (value, -id)) AS anchor, count(*) AS members FROM w GROUP BY video_id")
def packet_groups(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(F.desc("value"), "id")
    x = intervals(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 6")
    n = lambda m: F.count(F.when(F.col("modality") == m, 1))
    kind = F.when((n("click") > 0) & (n("view") > 0), "causal").when(F.count_distinct("modality") == 1, "single").otherwise("mixed")
    return x.groupBy("video_id").agg(kind.alias("group_type"), F.max_by("id", F.struct("value", -F.col("id"))).alias("anchor"), F.count("*").alias("members"))


@query(f"WITH {IV} SELECT id, CASE WHEN modality IN ('click', 'view') THEN 'required' WHEN value > 30 THEN 'supporting' ELSE 'dropped' END AS accounting FROM iv")
def classify_modalities(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", F.when(F.col("modality").isin("click", "view"), "required").when(F.col("value") > 30, "supporting").otherwise("dropped").alias("accounting"))


@query(f"WITH {IV}, c AS (SELECT *, end_sec > 1704067200 + 86400 * 15 AS clipped, modality IN ('error', 'signup') AS broad FROM iv) SELECT id, CASE WHEN clipped AND broad THEN 'score_scope_wider' WHEN broad THEN 'broad' WHEN clipped THEN 'clipped' ELSE 'exact' END AS diagnostic, broad AND value > 80 AS affects FROM c")
def broad_score_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    clipped, broad = F.col("end_sec") > 1704067200 + 86400 * 15, F.col("modality").isin("error", "signup")
    return intervals(spark, d).select("id", F.when(clipped & broad, "score_scope_wider").when(broad, "broad").when(clipped, "clipped").otherwise("exact").alias("diagnostic"), (broad & (F.col("value") > 80)).alias("affects"))


@query(f"WITH {IV} SELECT id, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, id)::INTEGER AS selection, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id)::INTEGER AS position, abs(start_sec - 1705000000.0) AS from_anchor FROM iv")
def order_visual_frames(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).withColumn("anchor", F.lit(1705000000.0))
    return E.ranked_order(x, ["video_id"], "anchor").select("id", "selection", "position", "from_anchor")


@query(f"WITH {IV}, g AS (SELECT video_id, avg(CASE WHEN modality = 'click' AND value > 50 THEN (start_sec + end_sec) / 2 END) AS t, arg_max(start_sec, (value, -id)) FILTER (WHERE modality = 'view') AS v, min(start_sec) AS c FROM iv GROUP BY video_id) SELECT video_id, round(coalesce(t, v, c), 4) AS anchor, CASE WHEN t IS NOT NULL THEN 'temporal' WHEN v IS NOT NULL THEN 'visual' ELSE 'coarse' END AS basis FROM g")
def resolve_anchor(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d)
    t = F.avg(F.when((F.col("modality") == "click") & (F.col("value") > 50), (F.col("start_sec") + F.col("end_sec")) / 2))
    v = F.max_by("start_sec", F.when(F.col("modality") == "view", F.struct("value", -F.col("id"))))
    g = x.groupBy("video_id").agg(t.alias("t"), v.alias("v"), F.min("start_sec").alias("c"), F.count(F.when(F.col("modality") == "view", 1)).alias("nv"))
    g = g.withColumn("v", F.when(F.col("nv") > 0, F.col("v")))
    return g.select("video_id", F.round(F.coalesce("t", "v", "c"), 4).alias("anchor"), F.when(F.col("t").isNotNull(), "temporal").when(F.col("v").isNotNull(), "visual").otherwise("coarse").alias("basis"))


@query(f"WITH {IV}, f AS (SELECT video_id, CAST(start_sec AS BIGINT) // 3600 * 3600000 AS ms, CASE WHEN id % 3 = 0 THEN 'dense' ELSE 'micro' END AS provenance, 'p' || id AS path FROM iv) SELECT video_id, ms, arg_min(path, (CASE WHEN provenance <> 'dense' THEN 1 ELSE 0 END, path)) AS path, string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS lineage, count(*) AS n FROM f GROUP BY ALL")
def frame_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = intervals(spark, d).select("video_id", (F.floor(F.col("start_sec") / 3600).cast("long") * 3600000).alias("ms"), F.when(F.col("id") % 3 == 0, "dense").otherwise("micro").alias("provenance"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    return E.frames_dedup(f, ["video_id", "ms"])


@query(f"WITH {IV}, a AS (SELECT id, modality, round(value) AS v FROM iv WHERE id % 10 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'x' ELSE modality END AS modality, round(value) + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS v FROM iv WHERE id % 11 <> 0), j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL OR b.id IS NULL AS m, a.modality <> b.modality AS e, a.v <> b.v AS l FROM a FULL JOIN b ON a.id = b.id) SELECT CASE WHEN m THEN 'missing' WHEN e THEN 'mismatch' WHEN l THEN 'nondeterministic' ELSE 'exact' END AS category, count(*) AS n FROM j GROUP BY 1")
def state_diff(spark: SparkSession, d: str) -> DataFrame:
    iv = intervals(spark, d).withColumn("v", F.round("value"))
    b = iv.where("id % 11 <> 0").withColumn("modality", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("modality"))).withColumn("v", F.col("v") + F.when(F.col("id") % 5 == 0, 1).otherwise(0))
    return E.state_diff(iv.where("id % 10 <> 0"), b, "id", ["modality"], ["v"]).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {AT} SELECT uid, attempt, CASE WHEN status = 'error' THEN 'provider' WHEN status = 'timeout' THEN 'budget' WHEN pred = '' THEN 'answer_missing' WHEN pred NOT IN ('A','B','C','D','E') THEN 'answer_format' WHEN pred <> gold THEN 'answer_wrong' ELSE 'none' END AS category FROM att")
def failure_localisation(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("status"), F.col("pred")
    return attempts(spark, d).select("uid", "attempt", F.when(s == "error", "provider").when(s == "timeout", "budget").when(p == "", "answer_missing").when(~p.rlike("^[A-E]$"), "answer_format").when(p != F.col("gold"), "answer_wrong").otherwise("none").alias("category"))


@query(f"""WITH {IV}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, id) AS rank, greatest(0.0, 1704900000.0 - end_sec, start_sec - 1705000000.0) AS dist FROM iv)
SELECT video_id, bool_or(rank <= 1 AND dist = 0) AS top1, bool_or(rank <= 3 AND dist = 0) AS top3, bool_or(rank <= 20 AND dist = 0) AS hit20, min(dist) AS min_distance, arg_min(rank, (dist, rank)) AS closest_rank, min(CASE WHEN dist = 0 THEN rank END) AS reference_rank FROM r GROUP BY video_id""")
def eval_ranked_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    """With reference_retention."""
    from ..operators.intervals import distance

    w = Window.partitionBy("video_id").orderBy(F.desc("value"), "id")
    r = intervals(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).withColumn("dist", distance("start_sec", "end_sec", F.lit(1704900000.0), F.lit(1705000000.0)))
    hit = lambda k: F.some((F.col("rank") <= k) & (F.col("dist") == 0))
    return r.groupBy("video_id").agg(hit(1).alias("top1"), hit(3).alias("top3"), hit(20).alias("hit20"), F.min("dist").alias("min_distance"), F.min_by("rank", F.struct("dist", "rank")).alias("closest_rank"), F.min(F.when(F.col("dist") == 0, F.col("rank"))).alias("reference_rank"))


@query(f"""WITH {IV}, c AS (SELECT id, video_id, (id * 7) % 12000 AS cites, modality FROM iv), j AS (SELECT c.*, e.id AS found, e.video_id AS ev, e.modality AS em FROM c LEFT JOIN iv e ON e.id = c.cites)
SELECT id, CASE WHEN found IS NULL THEN 'unknown_citation' WHEN ev <> video_id THEN 'outside' WHEN em <> modality THEN 'modality_corrected' ELSE 'ok' END AS correction FROM j""")
def validate_and_correct(spark: SparkSession, d: str) -> DataFrame:
    iv = intervals(spark, d)
    c = iv.select("id", "video_id", "modality", ((F.col("id") * 7) % 12000).alias("cites"))
    e = iv.select(F.col("id").alias("cites"), F.lit(1).alias("found"), F.col("video_id").alias("ev"), F.col("modality").alias("em"))
    j = c.join(e, "cites", "left")
    return j.select("id", F.when(F.col("found").isNull(), "unknown_citation").when(F.col("ev") != F.col("video_id"), "outside").when(F.col("em") != F.col("modality"), "modality_corrected").otherwise("ok").alias("correction"))


@query(f"WITH {IV} SELECT modality AS type, round(value)::BIGINT AS claim, min(id) AS first_id, count(*) AS n FROM iv GROUP BY 1, 2")
def pipeline_uncertainties(spark: SparkSession, d: str) -> DataFrame:
    """The first of each type and claim."""
    return intervals(spark, d).groupBy(F.col("modality").alias("type"), F.round("value").cast("long").alias("claim")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


_STATES = ["pending", "sent", "response_saved", "validated", "checkpointed", "technical_failure"]
_NEXT = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in L.TRANSITIONS)


@query(f"""WITH j AS (SELECT user_id, event_id, (['pending','sent','response_saved','validated','checkpointed','technical_failure'])[CASE WHEN event_id % 13 = 0 THEN event_id % 6 + 1 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 + 1 END] AS state, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS attempt FROM events),
b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id, attempt ORDER BY event_id), '') AS before FROM j), t(x, y) AS ({_NEXT})
SELECT user_id, attempt, arg_max(state, event_id) AS last_state, count(*) AS n_events, count(*) FILTER (WHERE (before, state) NOT IN (SELECT (x, y) FROM t)) AS n_illegal, arg_max(state, event_id) NOT IN ('checkpointed', 'technical_failure') AS unfinished FROM b GROUP BY user_id, attempt""")
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    return L.journal_replay(_journal(spark, d), ["user_id", "attempt"], ["event_id"])


def _journal(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = F.row_number().over(w) - 1
    k = F.when(F.col("event_id") % 13 == 0, F.col("event_id") % 6).otherwise(r % 5)
    state = F.element_at(F.array(*map(F.lit, _STATES)), (k + 1).cast("int"))
    return table(spark, d, "events").select("user_id", "event_id", state.alias("state"), F.floor(r / 5).cast("long").alias("attempt"))


@query("WITH a AS (SELECT o_custkey % 500 AS logical, count(*) AS starts, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS ends, round(sum(o_totalprice), 2) AS ledger FROM orders GROUP BY 1) SELECT logical, starts - ends AS unpaired, starts > 30 AS too_many, ledger FROM a")
def request_pairing(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 500).alias("logical")).agg(F.count("*").alias("s"), F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("e"), F.round(F.sum("o_totalprice"), 2).alias("ledger"))
    return g.select("logical", (F.col("s") - F.col("e")).alias("unpaired"), (F.col("s") > 30).alias("too_many"), "ledger")


@query(f"WITH {AT}, q AS (SELECT DISTINCT uid FROM att WHERE uid % 10 <> 3), x AS (SELECT uid, attempt FROM q, (SELECT unnest([0, 1, 2]) AS attempt)) SELECT x.uid, x.attempt FROM x LEFT JOIN att a ON a.uid = x.uid AND a.attempt = x.attempt AND a.status = 'success' WHERE a.uid IS NULL")
def fixed_population(spark: SparkSession, d: str) -> DataFrame:
    """Expected question and route without a successful row."""
    a = attempts(spark, d)
    x = a.where("uid % 10 <> 3").select("uid").distinct().withColumn("attempt", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return x.join(a.where("status = 'success'").select("uid", "attempt"), ["uid", "attempt"], "left_anti")
