"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators.scans import Ordered, previous
from .fixtures import IV, intervals
from .registry import query

K = ["video_id"]


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    iv = intervals(spark, d)
    return iv.where("modality = 'view'"), iv.where("modality = 'click'")


AB = f"WITH {IV}, a AS (SELECT * FROM iv WHERE modality = 'view'), b AS (SELECT * FROM iv WHERE modality = 'click')"
MERGED = """m0 AS (SELECT *, max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {src}),
m1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_sec > pm + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id) AS island FROM m0),
m AS (SELECT video_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n_sources FROM m1 GROUP BY video_id, island)"""


@query(f"{AB} SELECT a.id, b.id AS other_id, round(least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec), 6) AS overlap FROM a JOIN b ON a.video_id = b.video_id AND a.start_sec < b.end_sec AND a.end_sec > b.start_sec")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    met = I.interval_join(a, b, K, width=I.BUCKET)
    return met.select("id", F.col("id_r").alias("other_id"), F.round(I.overlap_seconds("start_sec", "end_sec", "start_sec_r", "end_sec_r"), 6).alias("overlap"))


@query(f"{AB} SELECT a.id, count(*) AS n_open, sum(CASE WHEN a.end_sec = b.start_sec OR b.end_sec = a.start_sec THEN 1 ELSE 0 END)::BIGINT AS n_touch FROM a JOIN b ON a.video_id = b.video_id AND NOT (a.end_sec < b.start_sec OR b.end_sec < a.start_sec) GROUP BY a.id")
def overlap_closed_pred(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    met = I.interval_join(a, b, K, closed=True)
    touch = (F.col("end_sec") == F.col("start_sec_r")) | (F.col("end_sec_r") == F.col("start_sec"))
    return met.groupBy("id").agg(F.count("*").alias("n_open"), F.sum(touch.cast("long")).alias("n_touch"))


@query(f"WITH {IV} SELECT id, greatest(0.0, least(end_sec, 1704200000.0) - greatest(start_sec, 1704100000.0)) AS overlap_sec, greatest(0.0, 1704100000.0 - end_sec, start_sec - 1704200000.0) AS gap_sec, start_sec < 1704200000.0 AND end_sec > 1704100000.0 AS hit FROM iv")
def overlap_seconds(spark: SparkSession, d: str) -> DataFrame:
    """With interval_distance and interval_overlap_pred."""
    iv = intervals(spark, d)
    a, b = F.lit(1704100000.0), F.lit(1704200000.0)
    return iv.select("id", I.overlap_seconds("start_sec", "end_sec", a, b).alias("overlap_sec"), I.distance("start_sec", "end_sec", a, b).alias("gap_sec"), I.overlaps("start_sec", "end_sec", a, b).alias("hit"))


@query(f"WITH {IV} SELECT id, CASE WHEN start_sec <= 1704150000.0 AND 1704150000.0 < end_sec THEN 0.0 ELSE least(abs(1704150000.0 - start_sec), abs(1704150000.0 - end_sec)) END AS dist FROM iv")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", I.point_distance(F.lit(1704150000.0), "start_sec", "end_sec").alias("dist"))


@query(f"""{AB}, j AS (SELECT a.id, a.video_id, a.start_sec AS s, a.end_sec AS e, b.start_sec AS rs, b.end_sec AS re, least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) AS ov
 FROM a JOIN b ON a.video_id = b.video_id AND a.start_sec < b.end_sec AND a.end_sec > b.start_sec)
SELECT video_id, id, greatest(s, rs) AS clip_start, least(e, re) AS clip_end, s AS source_start, e AS source_end FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY ov DESC, rs DESC, re DESC) = 1""")
def clip_to_interval(spark: SparkSession, d: str) -> DataFrame:
    return I.clip_to_best(*_two(spark, d), K)


@query(f"""WITH {IV}, p AS (SELECT *, 1704067200.0 + floor((start_sec - 1704067200.0) / 14400) * 14400 AS p0 FROM iv)
SELECT id, CASE WHEN end_sec <= p0 + 1e-6 OR start_sec >= p0 + 14400 - 1e-6 THEN 'excluded' WHEN start_sec < p0 - 1e-6 OR end_sec > p0 + 14400 + 1e-6 THEN 'clipped' ELSE 'valid' END AS state FROM p""")
def clip_asr_segment(spark: SparkSession, d: str) -> DataFrame:
    p = intervals(spark, d).withColumn("p0", 1704067200.0 + F.floor((F.col("start_sec") - 1704067200.0) / 14400) * 14400)
    return p.select("id", I.clipped_state("start_sec", "end_sec", "p0", F.col("p0") + 14400).alias("state"))


@query("""WITH x AS (SELECT event_id AS id, CAST(event_id % 100 AS DOUBLE) AS s, event_id % 100 + (event_id % 7) * 4.0 AS e FROM events)
SELECT id, CASE WHEN e - s >= 15 THEN greatest(0.0, s) ELSE greatest(0.0, least((s + e) / 2 - 7.5, 85.0)) END AS w_start,
 CASE WHEN e - s >= 15 THEN least(e, 100.0) ELSE greatest(0.0, least((s + e) / 2 - 7.5, 85.0)) + 15 END AS w_end FROM x""")
def widen_min_width(spark: SparkSession, d: str) -> DataFrame:
    from .fixtures import table

    s = (F.col("event_id") % 100).cast("double")
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), s.alias("s"), (s + (F.col("event_id") % 7) * 4.0).alias("e"))
    a, b = I.widened("s", "e", 15.0, F.lit(100.0))
    return x.select("id", a.alias("w_start"), b.alias("w_end"))


@query(f"""WITH {IV}, r AS (SELECT *, (['before','after','during','none'])[id % 4 + 1] AS rel FROM iv)
SELECT id, greatest(0.0, start_sec - CASE rel WHEN 'before' THEN 10 WHEN 'during' THEN 2 ELSE 0 END) AS x_start, end_sec + CASE rel WHEN 'after' THEN 10 WHEN 'during' THEN 2 ELSE 0 END AS x_end FROM r""")
def expand_interval_by_relation(spark: SparkSession, d: str) -> DataFrame:
    rel = F.element_at(F.array(*map(F.lit, ["before", "after", "during", "none"])), (F.col("id") % 4 + 1).cast("int"))
    a, b = I.expanded("start_sec", "end_sec", rel)
    return intervals(spark, d).select("id", a.alias("x_start"), b.alias("x_end"))


@query(f"WITH {IV}, {MERGED.format(src='iv', gap='1800.0')} SELECT * FROM m")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.merged(intervals(spark, d), K, 1800.0)


@query(f"WITH {IV}, {MERGED.format(src='iv', gap='0.0')} SELECT video_id, sum(end_sec - start_sec) AS union_seconds FROM m GROUP BY video_id")
def union_duration(spark: SparkSession, d: str) -> DataFrame:
    return I.union_duration(intervals(spark, d), K)


@query(f"WITH {IV}, {MERGED.format(src='iv', gap='0.0')}, g AS (SELECT video_id, end_sec AS gap_start, lead(start_sec) OVER (PARTITION BY video_id ORDER BY start_sec) AS gap_end FROM m) SELECT * FROM g WHERE gap_end IS NOT NULL")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(I.merged(intervals(spark, d), K), K)


@query(f"WITH {IV}, {MERGED.format(src='iv', gap='0.0')} SELECT video_id, round(sum(greatest(0.0, least(end_sec, 1705000000.0) - greatest(start_sec, 1704500000.0))) / 500000.0, 6) AS fraction, count(*) AS n_spans FROM m GROUP BY video_id")
def coverage_fraction(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lit(1704500000.0), F.lit(1705000000.0)
    m = I.merged(intervals(spark, d), K)
    return m.groupBy("video_id").agg(F.round(F.sum(I.overlap_seconds("start_sec", "end_sec", a, b)) / 500000.0, 6).alias("fraction"), F.count("*").alias("n_spans"))


@query(f"""{AB}, {MERGED.format(src='b', gap='0.0')},
f AS (SELECT video_id, end_sec AS fs, coalesce(lead(start_sec) OVER (PARTITION BY video_id ORDER BY start_sec), 'infinity'::DOUBLE) AS fe FROM m
 UNION ALL SELECT video_id, '-infinity'::DOUBLE, min(start_sec) FROM m GROUP BY video_id
 UNION ALL SELECT DISTINCT video_id, '-infinity'::DOUBLE, 'infinity'::DOUBLE FROM a WHERE video_id NOT IN (SELECT video_id FROM m))
SELECT a.video_id, a.id, greatest(start_sec, fs) AS left_start, least(end_sec, fe) AS left_end FROM a JOIN f ON a.video_id = f.video_id AND start_sec < fe AND end_sec > fs""")
def subtract_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.subtracted(*_two(spark, d), K)


@query(f"""{AB}, s AS (SELECT a.id, sum(least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) AS s FROM a JOIN b ON a.video_id = b.video_id AND a.start_sec < b.end_sec AND a.end_sec > b.start_sec GROUP BY a.id)
SELECT a.video_id, a.id, least(1.0, coalesce(s, 0.0) / (end_sec - start_sec)) AS ratio FROM a LEFT JOIN s USING (id)""")
def interval_overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    return I.cover_ratio(*_two(spark, d), K)


@query(f"""WITH {IV}, l AS (SELECT video_id, id, start_sec, end_sec, CASE WHEN lag(id) OVER w IS NULL OR start_sec - max(end_sec) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 7200 THEN 1 ELSE 0 END AS n FROM iv WINDOW w AS (PARTITION BY video_id ORDER BY start_sec, end_sec, id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id) AS grp FROM l)
SELECT video_id, CAST(grp AS BIGINT) AS window_no, min(start_sec) AS start_sec, max(end_sec) AS end_sec, array_to_string(list(id ORDER BY start_sec, end_sec, id), ',') AS members FROM g GROUP BY video_id, grp""")
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = I.with_islands(intervals(spark, d), K, 7200.0)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "id"))), lambda x: x["id"].cast("string")), ",")
    return g.groupBy("video_id", F.col("island").alias("window_no")).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), members.alias("members"))


@query(f"""WITH {IV}, r AS (SELECT video_id, id, start_sec, value > 50 AS on_ FROM iv),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS i FROM r), g AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, on_ ORDER BY i) AS grp FROM n)
SELECT video_id, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM g WHERE on_ GROUP BY video_id, grp HAVING count(*) >= 2""")
def mask_to_intervals(spark: SparkSession, d: str) -> DataFrame:
    n = Ordered(intervals(spark, d).withColumn("on_", F.col("value") > 50), K, ["start_sec", "id"])
    n = n.running("i", F.lit(1).cast("long"), "sum", inclusive=True).running("k", F.col("on_").cast("long"), "sum", inclusive=True).rows()
    on = n.where("on_").withColumn("grp", F.col("i") - F.col("k"))
    return on.groupBy("video_id", "grp").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n")).where("n >= 2").drop("grp")


@query(f"""{AB}, j AS (SELECT a.id, a.video_id, a.start_sec, b.id AS sub, b.end_sec AS be, row_number() OVER (PARTITION BY a.id ORDER BY b.start_sec DESC, b.id DESC) AS rn FROM a LEFT JOIN b ON a.video_id = b.video_id AND b.start_sec <= a.start_sec)
SELECT video_id, id, start_sec, CASE WHEN start_sec < be THEN sub END AS sub_id FROM j WHERE rn = 1""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    r = b.groupBy("video_id", "start_sec").agg(F.max(F.struct(F.col("id").alias("sub_id"), "end_sec")).alias("r")).select("video_id", "start_sec", "r.*")
    return I.as_of(a.select("video_id", "start_sec", "id"), r, K, "start_sec", ["sub_id"], "end_sec")


@query(f"""{AB}, j AS (SELECT a.video_id, a.id, b.id AS nearest_id, greatest(0.0, b.start_sec - a.end_sec, a.start_sec - b.end_sec) AS dist FROM a JOIN b USING (video_id))
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nearest_id) = 1""")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    return I.nearest(*_two(spark, d), K)


@query(f"""{AB}, j AS (SELECT a.id, a.video_id, b.value, b.id AS fid FROM a JOIN b ON a.video_id = b.video_id AND b.start_sec >= a.start_sec AND b.start_sec < a.end_sec)
SELECT id, count(*) AS n_frames, max(value) AS best, arg_max(fid, (value, -fid)) AS best_frame FROM j GROUP BY id""")
def point_in_interval_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    r = b.select("video_id", F.col("start_sec").alias("t"), F.col("value").alias("score"), F.col("id").alias("fid"))
    met = I.points_in(a.select("video_id", "id", "start_sec", "end_sec"), r, K)
    return met.groupBy("id").agg(F.count("*").alias("n_frames"), F.max("score").alias("best"), F.max_by("fid", F.struct("score", -F.col("fid"))).alias("best_frame"))


@query(f"{AB} SELECT id, video_id FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.video_id = b.video_id AND (b.start_sec + b.end_sec) / 2 >= a.start_sec AND (b.start_sec + b.end_sec) / 2 < a.end_sec)")
def center_in_selected_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    mids = b.select("video_id", "id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("t"))
    # merged spans don't overlap, so a middle lies in one at most
    return I.points_in(I.merged(a, K), mids, K).select("id", "video_id")


@query(f"{AB} SELECT a.id AS trigger_id, b.id AS response_id, b.start_sec - a.end_sec AS delay FROM a JOIN b ON a.video_id = b.video_id AND b.start_sec - a.end_sec BETWEEN 0 AND 7200")
def delay_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    reach = a.withColumn("end_of_trigger", F.col("end_sec")).withColumn("start_sec", F.col("end_sec")).withColumn("end_sec", F.col("end_sec") + 7201)
    points = b.withColumn("end_sec", F.col("start_sec") + 1)
    met = I.interval_join(reach, points, K, width=7200.0).withColumn("delay", F.col("start_sec_r") - F.col("end_of_trigger"))
    return met.where("delay between 0 and 7200").select(F.col("id").alias("trigger_id"), F.col("id_r").alias("response_id"), "delay")


@query(f"""{AB}, t AS (SELECT a.id AS tid, b.id AS rid, b.start_sec AS rs FROM a JOIN b ON a.video_id = b.video_id AND b.start_sec >= a.end_sec AND b.start_sec < a.end_sec + 36000)
SELECT x.tid AS trigger_id, x.rid AS response_a, y.rid AS response_b FROM t x JOIN t y ON x.tid = y.tid AND x.rid < y.rid""")
def theta_pair_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    r = b.select("video_id", F.col("id").alias("rid"), F.col("start_sec").alias("t"))
    after = a.select("video_id", F.col("id").alias("trigger_id"), F.col("end_sec").alias("start_sec"), (F.col("end_sec") + 36000).alias("end_sec"))
    t = I.points_in(after, r, K).select("trigger_id", "rid")
    return t.alias("x").join(t.alias("y"), "trigger_id").where("x.rid < y.rid").select("trigger_id", F.col("x.rid").alias("response_a"), F.col("y.rid").alias("response_b"))


@query(f"""WITH {IV}, l AS (SELECT video_id, start_sec, lag(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, id) AS p FROM iv)
SELECT video_id, bool_and(p IS NULL OR abs(start_sec - p) <= 1e-3) AS complete, count(*) FILTER (WHERE start_sec - p > 1e-3) AS n_gaps, count(*) FILTER (WHERE p - start_sec > 1e-3) AS n_overlaps FROM l GROUP BY video_id""")
def complete_coverage(spark: SparkSession, d: str) -> DataFrame:
    x = previous(Ordered(intervals(spark, d), K, ["start_sec", "end_sec", "id"]), "p", "end_sec").rows().withColumn("g", F.col("start_sec") - F.col("p"))
    return x.groupBy("video_id").agg(F.every(F.coalesce(F.abs("g") <= 1e-3, F.lit(True))).alias("complete"), F.count(F.when(F.col("g") > 1e-3, 1)).alias("n_gaps"), F.count(F.when(F.col("g") < -1e-3, 1)).alias("n_overlaps"))


@query("""WITH n AS (SELECT event_id AS pts, floor(value * 100)::BIGINT AS wanted FROM events), c AS (SELECT DISTINCT floor(epoch(ts))::BIGINT % 1000 AS idx FROM events WHERE event_id % 3 = 0),
j AS (SELECT pts, idx, abs(idx - wanted % 1000) AS dist, row_number() OVER (PARTITION BY pts ORDER BY abs(idx - wanted % 1000), idx) AS rn FROM n, c)
SELECT pts, idx AS frame, dist FROM j WHERE rn = 1""")
def nearest_integer_probe(spark: SparkSession, d: str) -> DataFrame:
    """The nearest existing frame, the earlier on a tie: the last at or before and the first at or after, no cross join."""
    from .fixtures import seconds, table

    e = table(spark, d, "events")
    want = e.select(F.col("event_id").alias("pts"), (F.floor(F.col("value") * 100).cast("long") % 1000).alias("at"), F.lit(None).cast("long").alias("frame"))
    have = e.where("event_id % 3 = 0").select(F.lit(None).cast("long").alias("pts"), (seconds("cast(ts as timestamp_ntz)").cast("long") % 1000).alias("at")).distinct().withColumn("frame", F.col("at"))
    # wanted places are spread over so many shares, each with all frames: there are a thousand at most
    shares = 32
    want = want.withColumn("part", F.pmod(F.xxhash64("pts"), F.lit(shares)).cast("int"))
    have = have.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    up = Window.partitionBy("part").orderBy("at", F.col("pts").isNotNull(), "pts").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.desc("at"), F.col("pts").isNotNull(), "pts").rowsBetween(Window.unboundedPreceding, 0)
    x = want.unionByName(have).withColumn("lo", F.last("frame", True).over(up)).withColumn("hi", F.last("frame", True).over(down)).where("pts is not null")
    low = F.col("hi").isNull() | (F.col("at") - F.col("lo") <= F.col("hi") - F.col("at"))
    return x.withColumn("f", F.when(low & F.col("lo").isNotNull(), F.col("lo")).otherwise(F.col("hi"))).select("pts", F.col("f").alias("frame"), F.abs(F.col("f") - F.col("at")).alias("dist"))
