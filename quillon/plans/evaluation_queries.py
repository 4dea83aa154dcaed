"""Queries of evaluation analytics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as ST
from ..operators import evaluate as E
from ..operators import sketches as K
from ..sources.files import written
from .fixtures import AT, attempts, table
from .registry import query

STRICT = "(status = 'success' AND regexp_matches(pred, '^[A-E]$'))"
MG = f"{AT}, mg AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY uid ORDER BY {STRICT} DESC, CASE WHEN {STRICT} THEN attempt ELSE -attempt END) = 1)"
LB = "lb AS (SELECT d.doc_id, d.lang, d.source, quality, toxic FROM documents d JOIN labels l USING (doc_id))"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return E.retry_merge(attempts(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")


@query(f"WITH {AT} SELECT uid, attempt, {STRICT} AS strict FROM att")
def strict_completion(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).select("uid", "attempt", E.strict_complete().alias("strict"))


@query(f"WITH {AT} SELECT CASE WHEN status = 'success' THEN 'success' WHEN status LIKE '%timeout%' THEN 'timeout' WHEN status <> '' THEN 'error' ELSE 'missing' END AS class, count(*) AS n FROM att GROUP BY 1")
def status_classify(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).groupBy(E.status_class().alias("class")).agg(F.count("*").alias("n"))


_MSG = "['CUDA out of memory', 'CUDA error', 'HTTP 429', 'invalid JSON', 'what', '']"


@query(f"WITH m AS (SELECT o_orderkey, lower(CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE ({_MSG})[o_orderkey % 6 + 1] || ' in ' || o_orderpriority || ' of ' || o_custkey END) AS m FROM orders) SELECT o_orderkey, CASE WHEN m = '' THEN 'none' WHEN m LIKE '%out of memory%' OR m LIKE '%oom%' THEN 'oom' WHEN m LIKE '%cuda%' THEN 'cuda' WHEN m LIKE '%http%' OR m LIKE '%connection%' OR m LIKE '%429%' THEN 'http' WHEN m LIKE '%json%' OR m LIKE '%parse%' THEN 'parse' ELSE 'other' END AS type FROM m")
def error_type_classify(spark: SparkSession, d: str) -> DataFrame:
    """With failure_classify: ordered substring rules."""
    m = F.element_at(F.array(*map(F.lit, ["CUDA out of memory", "CUDA error", "HTTP 429", "invalid JSON", "what", ""])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    m = F.when(F.col("o_orderkey") % 6 == 5, "").otherwise(F.concat(m, F.lit(" in "), "o_orderpriority", F.lit(" of "), F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", E.error_type(m).alias("type"))


@query(f"WITH {MG} SELECT uid, attempt, status, pred, elapsed_sec FROM mg")
def retry_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("uid", "attempt", "status", "pred", "elapsed_sec")


@query(f"WITH {MG}, pop AS (SELECT DISTINCT o_orderkey // 3 AS uid FROM orders UNION SELECT -1 - unnest(range(100))) SELECT count(*) AS population, sum(CASE WHEN {STRICT} AND pred = gold THEN 1 ELSE 0 END)::BIGINT AS correct, round(sum(CASE WHEN {STRICT} AND pred = gold THEN 1 ELSE 0 END) / count(*), 6) AS rate, round(sum(CASE WHEN {STRICT} AND pred = gold THEN 1 ELSE 0 END) / count(CASE WHEN {STRICT} THEN 1 END), 6) AS rate_completed FROM pop LEFT JOIN mg USING (uid)")
def rate_fixed_denominator(spark: SparkSession, d: str) -> DataFrame:
    """With rate_completed_only; a hundred planned questions were never run: their numbers are below zero, where no question that was run has one."""
    m = _merged(spark, d)
    pop = m.select("uid").unionByName(spark.range(100).select((-1 - F.col("id")).alias("uid")))
    j = pop.join(m, "uid", "left")
    ok = F.sum(F.coalesce(E.strict_complete() & (F.col("pred") == F.col("gold")), F.lit(False)).cast("long"))
    done = F.count(F.when(E.strict_complete(), 1))
    return j.agg(F.count("*").alias("population"), ok.alias("correct"), F.round(ok / F.count("*"), 6).alias("rate"), F.round(F.try_divide(ok, done), 6).alias("rate_completed"))


@query(f"WITH {AT} SELECT stage, count(elapsed_sec) AS n, round(sum(elapsed_sec), 4) AS total, round(avg(elapsed_sec), 6) AS mean, round(quantile_cont(elapsed_sec, 0.5), 6) AS median, round(quantile_cont(elapsed_sec, 0.9), 6) AS p90, round(quantile_cont(elapsed_sec, 0.95), 6) AS p95, min(elapsed_sec) AS low, max(elapsed_sec) AS high FROM att GROUP BY stage")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    """With percentile_linear."""
    x = "elapsed_sec"
    p = lambda q: F.round(F.percentile(x, F.lit(q)), 6)
    return attempts(spark, d).groupBy("stage").agg(F.count(x).alias("n"), F.round(F.sum(x), 4).alias("total"), F.round(F.avg(x), 6).alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.min(x).alias("low"), F.max(x).alias("high"))


@query(f"WITH {AT}, r AS (SELECT stage, elapsed_sec, row_number() OVER (PARTITION BY stage ORDER BY elapsed_sec) AS r, count(*) OVER (PARTITION BY stage) AS n FROM att) SELECT stage, elapsed_sec AS nearest_rank FROM r WHERE r = ceil(round(0.95 * n, 9))")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ST.nearest_rank(attempts(spark, d), ["stage"], "elapsed_sec", 0.95)


@query(f"WITH {AT}, a AS (SELECT stage, list(elapsed_sec ORDER BY elapsed_sec) AS v FROM att GROUP BY stage) SELECT stage, v[1 + CAST(floor(0.975 * (len(v) - 1)) AS BIGINT)] AS value FROM a")
def percentile_trunc(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stage")
    x = attempts(spark, d).withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("elapsed_sec")))
    return x.where(F.col("r") == 1 + F.floor(0.975 * (F.col("n") - 1))).select("stage", F.col("elapsed_sec").alias("value"))


@query(f"WITH {AT} SELECT stage, round(avg(CASE WHEN status = 'success' THEN elapsed_sec END), 6) AS executed_mean, round(sum(CASE WHEN status = 'success' THEN elapsed_sec END) / count(*), 6) AS amortised_mean FROM att GROUP BY stage")
def executed_vs_amortised_mean(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("status") == "success", F.col("elapsed_sec"))
    return attempts(spark, d).groupBy("stage").agg(F.round(F.avg(x), 6).alias("executed_mean"), F.round(F.sum(x) / F.count("*"), 6).alias("amortised_mean"))


@query(f"WITH {AT} SELECT coalesce(stage, 'all') AS stage, count(*) AS requests, sum(tokens)::BIGINT AS tokens, round(sum(elapsed_sec), 3) AS latency, count(CASE WHEN status = 'success' THEN 1 END) AS accepted, sum(CASE WHEN status = 'success' THEN tokens ELSE 0 END)::BIGINT AS accepted_tokens FROM att GROUP BY GROUPING SETS ((stage), ())")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """With metrics_rollup."""
    ok = F.col("status") == "success"
    g = attempts(spark, d).rollup("stage").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.sum("elapsed_sec"), 3).alias("latency"), F.count(F.when(ok, 1)).alias("accepted"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("accepted_tokens"))
    return g.withColumn("stage", F.coalesce("stage", F.lit("all")))


@query(f"WITH {MG} SELECT coalesce(video_id, -1) AS video_id, count(*) AS total, count(CASE WHEN {STRICT} AND pred = gold THEN 1 END) AS correct, round(count(CASE WHEN {STRICT} AND pred = gold THEN 1 END) / count(*), 6) AS accuracy FROM mg GROUP BY ROLLUP (video_id)")
def accuracy_by_video(spark: SparkSession, d: str) -> DataFrame:
    ok = F.count(F.when(E.strict_complete() & (F.col("pred") == F.col("gold")), 1))
    g = _merged(spark, d).rollup("video_id").agg(F.count("*").alias("total"), ok.alias("correct"), F.round(ok / F.count("*"), 6).alias("accuracy"))
    return g.withColumn("video_id", F.coalesce("video_id", F.lit(-1)))


@query(f"WITH {MG} SELECT CASE WHEN grouping(stage) = 0 THEN 'stage' WHEN grouping(status) = 0 THEN 'status' ELSE 'gold' END AS dimension, coalesce(stage, status, gold) AS value, count(*) AS n, round(avg(elapsed_sec), 6) AS mean FROM mg GROUP BY GROUPING SETS ((stage), (status), (gold))")
def breakdown_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    g = _merged(spark, d).groupingSets([[F.col("stage")], [F.col("status")], [F.col("gold")]], "stage", "status", "gold").agg(F.count("*").alias("n"), F.round(F.avg("elapsed_sec"), 6).alias("mean"), F.grouping("stage").alias("g1"), F.grouping("status").alias("g2"))
    return g.select(F.when(F.col("g1") == 0, "stage").when(F.col("g2") == 0, "status").otherwise("gold").alias("dimension"), F.coalesce("stage", "status", "gold").alias("value"), "n", "mean")


@query(f"WITH {LB}, dom AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS label) SELECT label, count(doc_id) AS n FROM dom LEFT JOIN lb ON lang = label GROUP BY label")
def count_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Over a fixed domain; labels that don't occur count 0."""
    dom = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "label string")
    n = _labelled(spark, d).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    return dom.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


PAIR = f"{AT}, pr AS (SELECT uid, stage, max(CASE WHEN attempt = 0 THEN ok END) AS a, max(CASE WHEN attempt = 1 THEN ok END) AS b FROM (SELECT uid, min(stage) OVER (PARTITION BY uid) AS stage, attempt, CASE WHEN {STRICT} AND pred = gold THEN 1 ELSE 0 END AS ok FROM att) GROUP BY uid, stage HAVING a IS NOT NULL AND b IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    x = attempts(spark, d).withColumn("ok", E.strict_complete() & (F.col("pred") == F.col("gold")))
    p = E.paired(x, "uid", "attempt", 0, 1, "ok")
    return p.join(x.groupBy("uid").agg(F.min("stage").alias("stage")), "uid")


_T = "count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS both, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS left_only, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS right_only, count(CASE WHEN a = 0 AND b = 0 THEN 1 END) AS neither"


@query(f"WITH {PAIR} SELECT stage, {_T} FROM pr GROUP BY stage")
def paired_table(spark: SparkSession, d: str) -> DataFrame:
    """With self_join_paired, as one aggregate."""
    return E.paired_table(_pairs(spark, d), ["stage"])


@query(f"WITH {AT}, w AS (SELECT uid, max(CASE WHEN attempt = 0 THEN status END) AS before, max(CASE WHEN attempt = 1 THEN status END) AS after FROM att GROUP BY uid) SELECT before, after, count(*) AS n FROM w WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY 1, 2")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = lambda k: F.max(F.when(F.col("attempt") == k, F.col("status")))
    w = attempts(spark, d).groupBy("uid").agg(s(0).alias("before"), s(1).alias("after")).dropna()
    return w.groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {PAIR}, t AS (SELECT stage, {_T} FROM pr GROUP BY stage), s AS (SELECT stage, left_only + right_only AS n, least(left_only, right_only) AS k, 0 AS i, (left_only + right_only) * ln(0.5) AS lg FROM t
 UNION ALL SELECT stage, n, k, i + 1, lg + ln((n - i) / (i + 1)) FROM s WHERE i < k), p AS (SELECT stage, round(CASE WHEN max(n) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lg))) END, 8) AS p FROM s GROUP BY stage),
r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, stage) + 1) * p) AS s FROM p)
SELECT stage, p, round(max(s) OVER (ORDER BY p, stage ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM r""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """With holm_adjust over the stages."""
    t = E.paired_table(_pairs(spark, d), ["stage"])
    p = t.select("stage", F.round(ST.mcnemar_exact(F.col("left_only"), F.col("right_only")), 8).alias("p"))
    return ST.holm(p, tie="stage").withColumn("p_holm", F.round("p_holm", 8))


@query(f"WITH {LB}, g AS (SELECT lang, count(*) AS n, sum(quality) / count(*) AS p FROM lb GROUP BY lang), z AS (SELECT *, 1.959963984540054 AS z FROM g) SELECT lang, n, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    g = _labelled(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    lo, hi = ST.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query(f"""WITH {AT}, d0 AS (SELECT st AS stage, uid, max(CASE WHEN attempt = 0 THEN elapsed_sec END) - max(CASE WHEN attempt = 1 THEN elapsed_sec END) AS e FROM (SELECT *, min(stage) OVER (PARTITION BY uid) AS st FROM att) GROUP BY ALL), d1 AS (SELECT stage, floor(e / 10) AS d FROM d0 WHERE e IS NOT NULL),
r AS (SELECT stage, d, rank() OVER (PARTITION BY stage ORDER BY abs(d)) + (count(*) OVER (PARTITION BY stage, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY stage, abs(d)) AS t FROM d1 WHERE d <> 0),
g AS (SELECT stage, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY stage)
SELECT stage, n, w AS w_plus, round((w - n * (n + 1) / 4 - sign(w - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM g""")
def wilcoxon_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    x = attempts(spark, d)
    e = lambda k: F.max(F.when(F.col("attempt") == k, F.col("elapsed_sec")))
    df = x.groupBy("uid").agg(F.min("stage").alias("stage"), F.floor((e(0) - e(1)) / 10).cast("double").alias("d")).where("d is not null")
    return ST.wilcoxon(df, ["stage"]).select("stage", "n", F.col("w_plus").cast("double"), F.round("z", 6).alias("z"))


@query(f"WITH {LB}, c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM lb GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), pe AS (SELECT sum(x * y) AS xy FROM (SELECT a AS k, sum(n) AS x FROM c GROUP BY a) JOIN (SELECT b AS k, sum(n) AS y FROM c GROUP BY b) USING (k)) SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS po, round(xy / (n * n), 6) AS pe, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM s, pe")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = ST.kappa(_labelled(spark, d), "quality", "toxic")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")])


@query(f"WITH {LB} SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS gained, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS lost, count(*) FILTER (WHERE quality = toxic) AS same, (sum(quality) - sum(toxic))::BIGINT AS net FROM lb GROUP BY lang")
def binary_agreement(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return _labelled(spark, d).groupBy("lang").agg(n("quality = 1 and toxic = 0").alias("gained"), n("quality = 0 and toxic = 1").alias("lost"), n("quality = toxic").alias("same"), (F.sum("quality") - F.sum("toxic")).cast("long").alias("net"))


@query("""WITH h AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, source, n / sum(n) OVER (PARTITION BY lang) AS p FROM h),
j AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM p WHERE lang = 'en') a FULL JOIN (SELECT * FROM p WHERE lang = 'de') b USING (source))
SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END))), 6) AS js_distance FROM j""")
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    j = p.where("lang = 'en'").select("source", "p").join(p.where("lang = 'de'").select("source", F.col("p").alias("q")), "source", "full").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return j.agg(F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(part(F.col("p")) + part(F.col("q"))))), 6).alias("js_distance"))


@query("SELECT doc_id, round((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) / greatest(1, count(*) OVER (PARTITION BY lang) - 1), 6) AS pr FROM documents")
def percent_rank_stable(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ranking import ranked

    r = ranked(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], ["n_chars", "doc_id"])
    return r.select("doc_id", F.round((F.col("rank") - 1) / F.greatest(F.lit(1), F.col("size") - 1), 6).alias("pr"))


@query()
def bootstrap_paired(spark: SparkSession, d: str) -> DataFrame:
    """The random draws are this library's own; SQL checks rows only."""
    p = _pairs(spark, d).withColumn("diff", F.col("a") - F.col("b"))
    return ST.bootstrap_paired(p, "diff", "uid", 500, 20)


@query()
def bootstrap_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Videos are resampled: their sums are drawn, not their rows."""
    c = _pairs(spark, d).groupBy((F.col("uid") % 12).alias("video_id")).agg(F.avg(F.col("a") - F.col("b")).alias("diff"))
    return ST.bootstrap_paired(c, "diff", "video_id", 2000, 20)


@query(f"WITH {AT}, rate AS (SELECT * FROM (VALUES ('1-URGENT', 2.5), ('2-HIGH', 1.25), ('3-MEDIUM', 0.4)) v(stage, usd)) SELECT stage, round(CAST(sum(tokens * usd) / 1000000.0 AS DOUBLE), 9) AS cost, count(*) AS n, count(usd) AS priced FROM att LEFT JOIN rate USING (stage) GROUP BY stage")
def cost(spark: SparkSession, d: str) -> DataFrame:
    """Decimal prices per million; without a price the cost is null."""
    r = spark.createDataFrame([("1-URGENT", "2.5"), ("2-HIGH", "1.25"), ("3-MEDIUM", "0.4")], "stage string, u string").select("stage", F.col("u").cast("decimal(10,4)").alias("usd"))
    j = attempts(spark, d).join(F.broadcast(r), "stage", "left")
    return j.groupBy("stage").agg(F.round((F.sum(F.col("tokens").cast("decimal(18,0)") * F.col("usd")) / 1000000).cast("double"), 9).alias("cost"), F.count("*").alias("n"), F.count("usd").alias("priced"))


@query(f"WITH {AT}, c AS (SELECT stage, tokens, CASE WHEN uid % 5 <> 0 THEN tokens % 700 END AS cached FROM att) SELECT stage, sum(greatest(tokens - cached, 0))::BIGINT AS uncached, sum(cached)::BIGINT AS hit, round(sum(cached) / sum(CASE WHEN cached IS NOT NULL THEN tokens END), 6) AS rate, count(*) - count(cached) AS unknown FROM c GROUP BY stage")
def cache_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Not recorded stays null; it isn't 0."""
    c = attempts(spark, d).withColumn("cached", F.when(F.col("uid") % 5 != 0, F.col("tokens") % 700))
    return c.groupBy("stage").agg(F.sum(F.greatest(F.col("tokens") - F.col("cached"), F.lit(0)) + F.col("cached") * 0).alias("uncached"), F.sum("cached").alias("hit"), F.round(F.try_divide(F.sum("cached"), F.sum(F.when(F.col("cached").isNotNull(), F.col("tokens")))), 6).alias("rate"), (F.count("*") - F.count("cached")).alias("unknown"))


@query(f"""WITH {AT}, c AS (SELECT uid, sum(CASE WHEN attempt > 0 THEN elapsed_sec END) AS child, max(CASE WHEN attempt = 0 THEN elapsed_sec END) AS parent FROM att GROUP BY uid)
SELECT count(*) FILTER (WHERE child > parent) AS child_exceeds, round(sum(greatest(parent - child, 0)), 3) AS overhead, count(*) FILTER (WHERE child IS NULL OR parent IS NULL) AS incomplete FROM c""")
def timing_consistency(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("elapsed_sec")
    c = attempts(spark, d).groupBy("uid").agg(F.sum(F.when(F.col("attempt") > 0, x)).alias("child"), F.max(F.when(F.col("attempt") == 0, x)).alias("parent"))
    return c.agg(F.count(F.when(F.expr("child > parent"), 1)).alias("child_exceeds"), F.round(F.sum(F.when(F.expr("child is not null"), F.greatest(F.col("parent") - F.col("child"), F.lit(0.0))).otherwise(F.when(F.col("parent").isNotNull(), F.lit(0.0)))), 3).alias("overhead"), F.count(F.when(F.expr("child is null or parent is null"), 1)).alias("incomplete"))


# -- sources' contracts, joins and sets -------------------------------------------


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_index(spark: SparkSession, d: str) -> DataFrame:
    return E.unique_violations(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT o_orderkey AS key, 'missing' AS violation FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 'duplicate' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def join_cardinality_assert(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage_violations(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT e.vec_id, e.label, d.lang, coalesce(d.source, 'none') AS source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def join_meta_by_id(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return table(spark, d, "embeddings").select("vec_id", "label").join(m, "vec_id", "left").withColumn("source", F.coalesce("source", F.lit("none")))


@query(f"WITH {MG} SELECT m.uid, m.pred, m.gold, m.pred = m.gold AS correct FROM mg m WHERE {STRICT} AND (SELECT count(*) FROM (SELECT uid FROM mg GROUP BY uid HAVING count(*) > 1)) = 0")
def join_gold_posthoc(spark: SparkSession, d: str) -> DataFrame:
    """Gold meets the answers only when the structure has no violation."""
    m = _merged(spark, d)
    gate = E.unique_violations(m.select("uid"), "uid").agg(F.count("*").alias("bad"))
    gold = attempts(spark, d).where("attempt = 0").select("uid", F.col("gold").alias("g"))
    j = m.where(E.strict_complete()).crossJoin(F.broadcast(gate)).where("bad = 0").join(gold, "uid")
    return j.select("uid", "pred", F.col("g").alias("gold"), (F.col("pred") == F.col("g")).alias("correct"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    rest = c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")
    yes = rest.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True))
    return yes.unionByName(rest.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query(f"WITH {AT}, s AS (SELECT uid, max(CASE WHEN attempt = 2 AND status = 'success' THEN pred END) AS ind, max(CASE WHEN attempt = 1 AND status = 'success' THEN pred END) AS cor, max(CASE WHEN attempt = 0 THEN pred END) AS orig FROM att GROUP BY uid) SELECT uid, coalesce(ind, cor, orig) AS pred, CASE WHEN ind IS NOT NULL THEN 'independent' WHEN cor IS NOT NULL THEN 'correction' ELSE 'original' END AS source FROM s")
def join_precedence(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    ok = F.col("status") == "success"
    part = lambda k, n, c: a.where((F.col("attempt") == k) & c).select("uid", F.col("pred").alias(n))
    j = a.select("uid").distinct().join(part(0, "orig", F.lit(True)), "uid", "left").join(part(2, "ind", ok), "uid", "left").join(part(1, "cor", ok), "uid", "left")
    return j.select("uid", F.coalesce("ind", "cor", "orig").alias("pred"), F.when(F.col("ind").isNotNull(), "independent").when(F.col("cor").isNotNull(), "correction").otherwise("original").alias("source"))


@query("SELECT s_suppkey, n_name, r_name, count(*) OVER (PARTITION BY r_name) AS in_region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hierarchy_join(spark: SparkSession, d: str) -> DataFrame:
    """Leaf to middle to root through exploded children lists; a leaf with two parents would show as two rows."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("kids"))
    up = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", F.explode("kids").alias("k"))
    s = table(spark, d, "supplier").join(up, F.col("s_nationkey") == F.col("k.n_nationkey"))
    return s.select("s_suppkey", F.col("k.n_name").alias("n_name"), "r_name", F.count("*").over(Window.partitionBy("r_name")).alias("in_region"))


@query("SELECT q.vec_id AS query_id, count(*) AS n, round(max(list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[])), 5) AS best FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id GROUP BY 1")
def cross_join_query_docs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.blocks import top_rows

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    best = top_rows(q, e, 1, "dot", 5, itself=False).select("query_id", F.col("score").alias("best"))
    # rows are counted, not paired: all with an id, less those with the query's own
    rows = e.agg(F.count("vec_id").alias("_all"))
    own = q.groupBy("query_id").agg(F.count("*").alias("_m"))
    n = own.crossJoin(F.broadcast(rows)).select("query_id", (F.col("_m") * (F.col("_all") - F.col("_m"))).alias("n")).where("n > 0")
    return n.join(best, "query_id", "left").select("query_id", "n", "best")


@query("(SELECT c_custkey AS k, 'both' AS side FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders) UNION ALL SELECT k, 'left' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersect, except and symmetric difference."""
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    tag = lambda x, s: x.withColumn("side", F.lit(s))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left")).unionByName(tag(b.subtract(a), "right"))


@query("WITH u AS (SELECT n_name AS x, 1 AS p, n_nationkey AS i FROM nation UNION ALL SELECT r_name, 2, r_regionkey FROM region UNION ALL SELECT n_name, 3, n_nationkey FROM nation) SELECT x, min(p) AS first_source FROM u GROUP BY x")
def union_distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("x"))
    u = n.withColumn("p", F.lit(1)).unionByName(table(spark, d, "region").select(F.col("r_name").alias("x")).withColumn("p", F.lit(2))).unionByName(n.withColumn("p", F.lit(3)))
    return u.groupBy("x").agg(F.min("p").alias("first_source"))


@query("WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b")
def multiset_equality(spark: SparkSession, d: str) -> DataFrame:
    """Empty differences both ways mean equality; by one aggregate."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey")
    g = li.groupBy("l_returnflag", "l_linenumber").agg(F.sum(F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1)).alias("x"))
    return g.agg(F.sum(F.greatest(F.col("x"), F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("x"), F.lit(0))).alias("only_b"))


@query("SELECT modality, count(*) AS found, count(*) FILTER (WHERE value > 20) AS gated, count(*) FILTER (WHERE value > 50) AS kept FROM (SELECT event_type AS modality, value FROM events) GROUP BY modality")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("modality")).agg(F.count("*").alias("found"), n("value > 20").alias("gated"), n("value > 50").alias("kept"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT (user_id, event_type)) AS pairs FROM events")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "event_type").alias("pairs"))


@query("""SELECT l_returnflag, count(*) AS rows, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY 1""")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each flag from sketches kept for every flag and month, united; close: within 3 % of the exact count."""
    l = table(spark, d, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey")
    kept = written(K.sketched(l, ["l_returnflag", "month"], "l_partkey"), "sketches")
    exact = l.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"))
    met = K.counted(K.united(kept, ["l_returnflag"])).join(exact, "l_returnflag")
    return met.select("l_returnflag", "rows", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close"))
