"""Queries that write and read files through the shared folder, and contracts on columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from .fixtures import IV, intervals, table
from .registry import query


def _path(spark: SparkSession, name: str) -> str:
    return f"{S.work_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(spark: SparkSession, d: str) -> DataFrame:
    """Whole-file arrays, one file for each region."""
    p = _path(spark, "json")
    n = table(spark, d, "nation")
    files = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value"))
    files.write.partitionBy("region").text(p)
    p = f"{p}/*/"
    return S.read_json(spark, p, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id, event_type, value, false AS bad FROM events UNION ALL SELECT NULL, NULL, NULL, true")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """With a line that is no object; with sink_jsonl."""
    p = _path(spark, "jsonl")
    e = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    e.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(p)
    r = S.read_jsonl(spark, p, "event_id long, event_type string, value double")
    return r.select("event_id", "event_type", "value", F.col("_corrupt").isNotNull().alias("bad"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def scan_jsonl_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key."""
    e = table(spark, d, "events").select("user_id", "event_id")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return S.last_by_key(e, "user_id", "event_id").join(n, "user_id")


@query("SELECT vec_id, label, vec_id % 4 AS shard FROM embeddings WHERE label = 3 AND vec_id % 4 = 1")
def scan_parquet_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Nested projection and filters reach the scan; shards by modulo."""
    p = _path(spark, "tasks")
    table(spark, d, "embeddings").select(F.struct("vec_id", "label").alias("extra_info"), "embedding").write.parquet(p)
    t = spark.read.parquet(p).where("extra_info.label = 3")
    return t.select("extra_info.vec_id", "extra_info.label").where("vec_id % 4 = 1").withColumn("shard", F.col("vec_id") % 4)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """With sink_csv."""
    p = _path(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(p)
    return S.read_csv(spark, p, "s_suppkey long, s_name string, s_acctbal double")


@query(f"WITH {IV} SELECT video_id, (id % 3600) * 1.0 AS start_sec, CASE WHEN id % 5 = 0 THEN (id % 3600) + 1.0 ELSE (id % 3600) + 2.5 END AS end_sec, string_agg(DISTINCT 'seg ' || id, ' ' ORDER BY 'seg ' || id) AS text FROM iv WHERE id % 7 <> 0 GROUP BY 1, 2, 3")
def scan_srt(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with empty texts and with ends before their starts."""
    s = F.col("id") % 3600
    clock = lambda x, ms: F.format_string(f"%02d:%02d:%02d,{ms}", F.floor(x / 3600), F.floor(x % 3600 / 60), x % 60)
    end = F.when(F.col("id") % 5 == 0, clock(s, "000")).otherwise(clock(s + 2, "500"))
    text = F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("seg\n"), F.col("id").cast("string")))
    b = intervals(spark, d).select("video_id", F.concat(F.lit("1\n"), clock(s, "000"), F.lit(" --> "), end, F.lit("\n"), text).alias("block"))
    return S.parse_srt(b, ["video_id"])


@query(f"WITH {IV}, x AS (SELECT video_id, start_sec, CASE WHEN id % 2 = 0 THEN end_sec END AS e, 't' || id AS text FROM iv), l AS (SELECT *, lead(start_sec) OVER (PARTITION BY video_id ORDER BY start_sec, text) AS nx FROM x) SELECT video_id, start_sec, CASE WHEN e > start_sec THEN e ELSE least(coalesce(nx, start_sec + 5), start_sec + 5) END AS end_sec, text FROM l")
def scan_sub_json(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).select("video_id", F.when(F.col("id") % 3 == 0, F.col("start_sec")).alias("begin"), F.when(F.col("id") % 3 != 0, F.col("start_sec")).alias("start_time"), F.when(F.col("id") % 2 == 0, F.col("end_sec")).alias("to"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    return S.parse_subtitles(x, ["video_id"])


@query("SELECT c_custkey % 1000 AS uid, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def scan_tree_glob(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files, indexed by uid; duplicates come out."""
    p = _path(spark, "tree")
    table(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("uid"), "c_mktsegment").write.partitionBy("c_mktsegment").json(p)
    t = S.read_tree(spark, f"{p}/*/", "uid long")
    return S.duplicates(t, "uid").groupBy("uid").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS uid, 'new' AS version FROM customer")
def scan_latest_file(spark: SparkSession, d: str) -> DataFrame:
    p = _path(spark, "latest")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"))
    for v in ("old", "new"):
        c.withColumn("version", F.lit(v)).coalesce(1).write.mode("append").json(p)
    t = S.read_tree(spark, p, "uid long, version string")
    return S.latest(t, ["uid"]).select("uid", "version")


@query("SELECT r_regionkey AS k, r_name AS name, NULL::BIGINT AS size FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def sink_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Union of columns, written once; a second write is refused. With sink_json_atomic by the committer."""
    p = _path(spark, "checkpoint")
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("size"))
    S.write_checkpoint(S.union_of_columns(a, b), p)
    return spark.read.parquet(p)


@query(r"SELECT conv_id, turn, replace(text, chr(10), '\n') AS text FROM conversations")
def sink_tsv(spark: SparkSession, d: str) -> DataFrame:
    p = _path(spark, "tsv")
    S.write_tsv(table(spark, d, "conversations").select("conv_id", "turn", "text"), p)
    r = spark.read.schema("conv_id long, turn long, text string").option("header", True).option("sep", "\t").option("escape", "\0").option("quote", "\0").csv(p)
    return r.select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", '^"|"$', ""), r'\\"', '"').alias("text"))


@query("SELECT 'region' AS name, 'missing' AS rule, 'r_comment' AS detail UNION ALL SELECT 'region', 'extra', 'r_name'")
def allowlist_project(spark: SparkSession, d: str) -> DataFrame:
    from ..schemas import column_violations

    return column_violations(table(spark, d, "region"), "region", ["r_regionkey", "r_comment"])


@query("SELECT doc_id, regexp_matches(lower(text), 'gold|ground_truth|password') AS leaks FROM documents")
def leakage_walk(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden fragments in any value of a nested row."""
    from ..schemas import leaks

    return table(spark, d, "documents").select("doc_id", leaks(F.struct("text"), ["gold", "ground_truth", "password"]).alias("leaks"))
