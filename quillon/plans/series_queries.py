"""Queries over series: windows, peaks, segments, greedy choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import folds
from ..operators import series as S
from ..operators.folds import walked
from .fixtures import IV, intervals, table
from .registry import query

O = ["start_sec", "id"]


def _w():
    """Made on use: a window needs a running session."""
    return Window.partitionBy("video_id").orderBy(*O)


OW = "(PARTITION BY video_id ORDER BY start_sec, id)"


@query(f"WITH {IV} SELECT id, row_number() OVER (PARTITION BY modality ORDER BY value DESC, id)::BIGINT AS rank, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, start_sec, id)::BIGINT AS rank_within FROM iv")
def row_number_rank(spark: SparkSession, d: str) -> DataFrame:
    a = Window.partitionBy("modality").orderBy(F.desc("value"), "id")
    b = Window.partitionBy("video_id").orderBy(F.desc("value"), *O)
    return intervals(spark, d).select("id", F.row_number().over(a).cast("long").alias("rank"), F.row_number().over(b).cast("long").alias("rank_within"))


@query(f"WITH {IV} SELECT id, round(value - lag(value) OVER {OW}, 6) AS diff, lead(start_sec) OVER {OW} AS next_start, max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before FROM iv")
def lag_difference(spark: SparkSession, d: str) -> DataFrame:
    """With lead and running max."""
    return intervals(spark, d).select("id", F.round(F.col("value") - F.lag("value").over(_w()), 6).alias("diff"), F.lead("start_sec").over(_w()).alias("next_start"), F.max("end_sec").over(_w().rowsBetween(Window.unboundedPreceding, -1)).alias("max_before"))


@query(f"WITH {IV} SELECT id, round(sum(value) OVER (PARTITION BY video_id ORDER BY start_sec, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM iv")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", F.round(S.moving_average("value", 5, ["video_id"], O), 6).alias("smooth"))


@query(f"WITH {IV}, p AS (SELECT id, video_id, coalesce(value >= lag(value) OVER {OW} AND value > lead(value) OVER {OW}, false) AS peak FROM iv) SELECT id, video_id FROM p WHERE peak")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).withColumn("peak", S.local_maximum("value", ["video_id"], O)).where("peak").select("id", "video_id")


@query(f"WITH {IV}, m AS (SELECT id, value, min(value) OVER (PARTITION BY video_id) AS lo, max(value) OVER (PARTITION BY video_id) AS hi FROM iv) SELECT id, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE round((value - lo) / (hi - lo), 6) END AS scaled FROM m")
def min_max_normalise(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", F.round(S.min_max("value", ["video_id"]), 6).alias("scaled"))


@query(f"WITH {IV}, l AS (SELECT *, lead(start_sec) OVER {OW} AS nx FROM iv) SELECT id, CASE WHEN id % 3 = 0 THEN least(coalesce(nx, start_sec + 5), start_sec + 5) ELSE end_sec END AS end_sec FROM l")
def lead_extension(spark: SparkSession, d: str) -> DataFrame:
    """Point-like segments (here every third) run to the next start, five seconds at most."""
    end = F.least(F.coalesce(F.lead("start_sec").over(_w()), F.col("start_sec") + 5), F.col("start_sec") + 5)
    return intervals(spark, d).select("id", F.when(F.col("id") % 3 == 0, end).otherwise(F.col("end_sec")).alias("end_sec"))


@query(f"WITH {IV}, t AS (SELECT *, floor(start_sec / 21600)::BIGINT AS w FROM iv) SELECT video_id, w * 21600.0 AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM t GROUP BY video_id, w")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    t = intervals(spark, d).withColumn("w", F.floor(F.col("start_sec") / 21600).cast("long"))
    return t.groupBy("video_id", "w").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select("video_id", (F.col("w") * F.lit(21600.0)).alias("window_start"), "n", "mean_value")


@query("""WITH c AS (SELECT doc_id, CAST(n_chars % 40 AS INTEGER) AS n, n_chars % 40 + (doc_id % 2) * 0.2 AS dur FROM documents),
w AS (SELECT *, greatest(0, ((n - 4) // 2)) * 2 AS lastw FROM c),
f AS (SELECT doc_id, unnest(CASE WHEN n <= 0 THEN [] WHEN n < 4 THEN [{'a': 0, 'b': n}] ELSE list_concat(list_transform(range(0, lastw + 1, 2), lambda s: {'a': CAST(s AS INTEGER), 'b': CAST(s AS INTEGER) + 4}), CASE WHEN dur > n AND lastw + 2 < n THEN [{'a': lastw + 2, 'b': n}] ELSE [] END) END) AS x FROM w)
SELECT doc_id, CAST(x.a AS INTEGER) AS first, CAST(x.b AS INTEGER) AS stop FROM f""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("n_chars") % 40).cast("int")
    dur = F.col("n_chars") % 40 + (F.col("doc_id") % 2) * 0.2
    return table(spark, d, "documents").select("doc_id", F.explode(S.sliding_windows(n, 4, 2, dur)).alias("x")).select("doc_id", "x.first", "x.stop")


@query("""WITH c AS (SELECT doc_id, CAST(n_chars % 100 AS INTEGER) AS n FROM documents), f AS (SELECT doc_id, n, unnest(range(0, n + 1, 15)) AS s FROM c)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 14, n) AS INTEGER) AS stop FROM f""")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(S.fixed_windows(F.col("n_chars") % 100, 15)).alias("x")).select("doc_id", "x.start", "x.stop")


@query(f"""WITH {IV}, h AS (SELECT video_id, bool_or(value > 200) AS found FROM iv GROUP BY video_id), w AS (SELECT video_id, found, unnest(range(0, 8, 2)) AS s FROM h)
SELECT video_id, CAST(s AS INTEGER) AS chunk_start, CAST(s + 4 AS INTEGER) AS chunk_end FROM w WHERE NOT found""")
def asr_chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of four seconds, every two, only where the complete pass has found nothing."""
    h = intervals(spark, d).groupBy("video_id").agg(F.some(F.col("value") > 200).alias("found")).where("not found")
    return h.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(2))).alias("chunk_start")).withColumn("chunk_end", F.col("chunk_start") + 4)


@query(f"""WITH RECURSIVE {IV}, p AS (SELECT video_id, start_sec AS t, value / 100 AS dist, row_number() OVER {OW} AS i FROM iv),
s AS (SELECT video_id, i, t, t AS cur, true AS starts FROM p WHERE i = 1 UNION ALL
 SELECT p.video_id, p.i, p.t, CASE WHEN dist >= 0.18 AND p.t - cur >= 86400 THEN p.t ELSE cur END, dist >= 0.18 AND p.t - cur >= 86400 FROM s JOIN p ON p.video_id = s.video_id AND p.i = s.i + 1),
e AS (SELECT video_id, max(t) AS last_t, max(cur) AS last_start, count(*) FILTER (WHERE starts) AS n FROM s GROUP BY video_id)
SELECT s.video_id, t AS segment_start FROM s JOIN e USING (video_id) WHERE starts AND NOT (n > 1 AND last_t - last_start < 86400 AND t = last_start)""")
def segment_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).withColumn("distance", F.col("value") / 100)
    return walked(x, ["video_id"], O, ["start_sec", "distance"], lambda: folds.Segments(0.18, 86400.0)).select("video_id", F.col("start_sec").alias("segment_start"))


@query(f"""WITH RECURSIVE {IV}, pk AS (SELECT *, coalesce(value >= lag(value) OVER {OW} AND value > lead(value) OVER {OW}, false) AS peak FROM iv),
md AS (SELECT video_id, quantile_cont(value, 0.5) AS med FROM iv GROUP BY video_id), mm AS (SELECT video_id, med, quantile_cont(abs(value - med), 0.5) AS mad FROM iv JOIN md USING (video_id) GROUP BY video_id, med),
p AS (SELECT video_id, start_sec AS t, row_number() OVER {OW} AS i FROM pk JOIN mm USING (video_id) WHERE peak AND value >= med + 0.5 * 1.4826 * mad),
g AS (SELECT video_id, i, t, t AS kept, true AS keep FROM p WHERE i = 1 UNION ALL SELECT p.video_id, p.i, p.t, CASE WHEN p.t - kept >= 172800 THEN p.t ELSE kept END, p.t - kept >= 172800 FROM g JOIN p ON p.video_id = g.video_id AND p.i = g.i + 1)
SELECT video_id, t AS boundary FROM g WHERE keep""")
def greedy_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Peaks above the median plus half a scaled MAD, each two days or more after the last one kept."""
    x = S.robust_scale(intervals(spark, d).withColumn("peak", S.local_maximum("value", ["video_id"], O)), "value", ["video_id"])
    x = x.where(F.col("peak") & (F.col("value") >= F.col("med") + 0.5 * 1.4826 * F.col("mad")))
    return walked(x, ["video_id"], O, ["start_sec"], lambda: folds.After(172800.0)).select("video_id", F.col("start_sec").alias("boundary"))


@query(f"""WITH {IV}, md AS (SELECT modality, quantile_cont(value, 0.5) AS med FROM iv GROUP BY modality), mm AS (SELECT modality, med, quantile_cont(abs(value - med), 0.5) AS mad FROM iv JOIN md USING (modality) GROUP BY modality, med)
SELECT id, round(greatest(0.0, (value - med) / (1.4826 * mad + 1e-8)), 6) AS scaled FROM iv JOIN mm USING (modality)""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return S.robust_scale(intervals(spark, d), "value", ["modality"]).select("id", F.round("scaled", 6).alias("scaled"))


@query(f"""WITH RECURSIVE {IV}, x AS (SELECT *, row_number() OVER {OW} AS i, value >= quantile_cont(value, 0.5) OVER (PARTITION BY video_id) AND coalesce(value >= lag(value) OVER {OW} AND value > lead(value) OVER {OW}, false) AS peak FROM iv),
g AS (SELECT video_id, i, 0 AS run, false AS cut FROM x WHERE i = 1 UNION ALL SELECT x.video_id, x.i, CASE WHEN peak OR run + 1 >= 4 THEN 0 ELSE run + 1 END, peak OR run + 1 >= 4 FROM g JOIN x ON x.video_id = g.video_id AND x.i = g.i + 1)
SELECT video_id, i AS cut_at FROM g WHERE cut""")
def split_local_max_or_forced(spark: SparkSession, d: str) -> DataFrame:
    m = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("video_id"))
    x = intervals(spark, d).withColumn("peak", S.local_maximum("value", ["video_id"], O) & (F.col("value") >= m)).withColumn("i", F.row_number().over(_w()).cast("long"))
    return walked(x, ["video_id"], ["i"], ["peak"], lambda: folds.Cuts(4)).select("video_id", F.col("i").alias("cut_at"))


@query(f"WITH {IV}, n AS (SELECT video_id, row_number() OVER {OW} AS i, value FROM iv), e AS (SELECT video_id, i FROM n WHERE value > 60) SELECT video_id, coalesce(lag(i) OVER (PARTITION BY video_id ORDER BY i) + 1, 1)::BIGINT AS first_i, i AS last_i FROM e")
def groups_from_ends(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d).withColumn("i", F.row_number().over(_w()).cast("long")).where("value > 60")
    return e.select("video_id", F.coalesce(F.lag("i").over(Window.partitionBy("video_id").orderBy("i")) + 1, F.lit(1)).cast("long").alias("first_i"), F.col("i").alias("last_i"))


@query(f"""WITH {IV}, n AS (SELECT *, row_number() OVER {OW} AS i FROM iv), g AS (SELECT *, (i - 1) // 8 AS region FROM n)
SELECT video_id, region, min(start_sec) AS start_sec, max(end_sec) AS end_sec, round(avg(value), 6) AS mean_rms, max(value) AS peak_rms, max(value) < 50 AS low_information FROM g GROUP BY video_id, region""")
def build_acoustic_regions(spark: SparkSession, d: str) -> DataFrame:
    g = intervals(spark, d).withColumn("region", F.floor((F.row_number().over(_w()) - 1) / 8).cast("long"))
    return g.groupBy("video_id", "region").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.round(F.avg("value"), 6).alias("mean_rms"), F.max("value").alias("peak_rms"), (F.max("value") < 50).alias("low_information"))


@query(f"""WITH {IV}, m0 AS (SELECT *, max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
m1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_sec > pm + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id) AS g FROM m0)
SELECT video_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, round(avg(value / 100), 6) AS mean_prob, min(value / 100) AS min_prob, max(value / 100) AS max_prob FROM m1 GROUP BY video_id, g""")
def vad_merge(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import with_islands

    p = F.col("value") / 100
    return with_islands(intervals(spark, d), ["video_id"], 0.5).groupBy("video_id", "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.round(F.avg(p), 6).alias("mean_prob"), F.min(p).alias("min_prob"), F.max(p).alias("max_prob")).drop("island")


@query(f"""WITH RECURSIVE {IV}, p AS (SELECT video_id, modality, id, start_sec AS t, row_number() OVER (PARTITION BY video_id, modality ORDER BY start_sec, id) AS i FROM iv),
g AS (SELECT video_id, modality, i, id, t AS kept, true AS keep FROM p WHERE i = 1 UNION ALL SELECT p.video_id, p.modality, p.i, p.id, CASE WHEN p.t - kept > 43200 THEN p.t ELSE kept END, p.t - kept > 43200 FROM g JOIN p ON p.video_id = g.video_id AND p.modality = g.modality AND p.i = g.i + 1)
SELECT id FROM g WHERE keep""")
def dedup_matches_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Per text (modality) a match within the tolerance of one kept goes."""
    return walked(intervals(spark, d), ["video_id", "modality"], ["start_sec", "id"], ["start_sec"], lambda: folds.After(43200.0, strict=True)).select("id")


_PREF = f"WITH RECURSIVE {IV}, p AS (SELECT video_id, id, (start_sec + end_sec) / 2 AS t, start_sec AS s, end_sec AS e, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, start_sec, id) AS i FROM iv)"


def _preferred(spark: SparkSession, d: str, needs: list[str], rule, fill: int = 0) -> DataFrame:
    """What a rule takes of a video's candidates in their order of preference."""
    x = intervals(spark, d).withColumn("t", (F.col("start_sec") + F.col("end_sec")) / 2)
    return walked(x, ["video_id"], [F.desc("value"), *O], needs, rule, fill).select("video_id", "id")


@query(f"""{_PREF}, g AS (SELECT video_id, i, CASE WHEN true THEN [t] END AS taken, [id] AS ids FROM p WHERE i = 1 UNION ALL
 SELECT p.video_id, p.i, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END FROM (SELECT p.*, g.taken, g.ids, len(g.taken) < 4 AND len(list_filter(g.taken, lambda y: abs(y - p.t) < 172800)) = 0 AS ok FROM g JOIN p ON p.video_id = g.video_id AND p.i = g.i + 1) p),
f AS (SELECT video_id, arg_max(ids, i) AS ids FROM g GROUP BY video_id), r AS (SELECT f.video_id, list(p.id ORDER BY p.i) AS rest FROM f JOIN p ON p.video_id = f.video_id WHERE NOT list_contains(ids, p.id) GROUP BY f.video_id)
SELECT f.video_id, unnest(list_concat(ids, list_slice(coalesce(rest, []), 1, greatest(0, 4 - len(ids))))) AS id FROM f LEFT JOIN r USING (video_id)""")
def time_diverse_centers(spark: SparkSession, d: str) -> DataFrame:
    """Four windows per video whose centres are two days apart, then filled up."""
    return _preferred(spark, d, ["t"], lambda: folds.Apart(172800.0, 4), fill=4)


@query(f"""{_PREF}, g AS (SELECT video_id, i, [{{'s': s, 'e': e}}] AS taken, [id] AS ids FROM p WHERE i = 1 UNION ALL
 SELECT video_id, i, CASE WHEN ok THEN list_append(taken, {{'s': s, 'e': e}}) ELSE taken END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END FROM (SELECT p.*, g.taken, g.ids, len(g.taken) < 4 AND len(list_filter(g.taken, lambda y: greatest(y.s - p.e, p.s - y.e) < 86400)) = 0 AS ok FROM g JOIN p ON p.video_id = g.video_id AND p.i = g.i + 1))
SELECT video_id, unnest(arg_max(ids, i)) AS id FROM g GROUP BY video_id""")
def time_diverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return _preferred(spark, d, ["start_sec", "end_sec"], lambda: folds.EdgesApart(86400.0, 4))


@query(f"""{_PREF.replace('RECURSIVE ', '')}, a AS (SELECT * FROM p WHERE i = 1), b AS (SELECT p.video_id, p.id, row_number() OVER (PARTITION BY p.video_id ORDER BY p.i) AS rn FROM p JOIN a USING (video_id) WHERE p.i > 1 AND (abs(p.t - a.t) >= 10 OR (p.s, p.e) <> (a.s, a.e)))
SELECT video_id, id FROM a UNION ALL SELECT video_id, id FROM b WHERE rn = 1""")
def diverse_pick_2(spark: SparkSession, d: str) -> DataFrame:
    return _preferred(spark, d, ["t", "start_sec", "end_sec"], lambda: folds.Another(10.0))


# -- vectors --------------------------------------------------------------------


@query("WITH l AS (SELECT vec_id, label, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, round(1 - list_dot_product(v::DOUBLE[], p::DOUBLE[]), 5) AS dist FROM l WHERE p IS NOT NULL")
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    l = table(spark, d, "embeddings").withColumn("p", F.lag("embedding").over(w)).where("p is not null")
    return l.select("vec_id", F.round(1 - V.dot(F.col("embedding"), F.col("p")), 5).alias("dist"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 5) AS first, true AS finite FROM embeddings")
def normalize_rows(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(e), 5).alias("norm"), F.round(V.unit(e)[0], 5).alias("first"), V.finite(e).alias("finite"))


_POOL = """x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"""


@query(f"WITH {_POOL} SELECT label, CAST(i AS INTEGER) AS dim, round(m / greatest(n, 1e-12), 5) AS value FROM m JOIN n USING (label)")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d).select("label", (F.col("i") + 1).alias("dim"), F.round(F.col("m") / F.col("n"), 5).alias("value"))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    n = m.groupBy("label").agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-12)).alias("n"))
    return m.join(n, "label")


@query(f"WITH {_POOL}, s AS (SELECT x.label, vec_id, sum(v * m) / max(n) AS s FROM x JOIN m USING (label, i) JOIN n ON n.label = x.label GROUP BY x.label, vec_id) SELECT label, arg_max(vec_id, (round(s, 9), -vec_id)) AS medoid FROM s GROUP BY label")
def medoid(spark: SparkSession, d: str) -> DataFrame:
    pooled = _pooled(spark, d).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("m") / F.col("n")).alias("u")))), lambda x: x["u"]).alias("pool"))
    e = table(spark, d, "embeddings").join(pooled, "label").withColumn("s", F.round(V.dot(F.col("embedding"), F.col("pool")), 9))
    return e.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("medoid"))
