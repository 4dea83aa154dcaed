"""The shapes that queries read, made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})").cast("double")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, video_id, modality, start_sec, end_sec, value: events that last one to five hours."""
    e = table(spark, sf_dir, "events")
    s = seconds("cast(ts as timestamp_ntz)")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("event_type").alias("modality"),
        s.alias("start_sec"), (s + 3600 * (1 + F.col("event_id") % 5)).alias("end_sec"), "value",
    )


IV = """iv AS (SELECT event_id AS id, user_id AS video_id, event_type AS modality, CAST(floor(epoch(ts)) AS DOUBLE) AS start_sec,
  CAST(floor(epoch(ts)) AS DOUBLE) + 3600 * (1 + event_id % 5) AS end_sec, value FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question and attempt, three of each: status, answer, gold, elapsed seconds, tokens, stage, video."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.expr("o_orderkey div 3").alias("uid"), (k % 3).cast("int").alias("attempt"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "timeout").otherwise("error").alias("status"),
        F.element_at(F.array(*map(F.lit, ["A", "B", "C", "D", "E", "x", ""])), (k * 7 % 11 % 7 + 1).cast("int")).alias("pred"),
        F.element_at(F.array(*map(F.lit, "ABCDE")), (F.expr("o_orderkey div 3") % 5 + 1).cast("int")).alias("gold"),
        (F.col("o_totalprice") / 1000).alias("elapsed_sec"), (F.floor("o_totalprice").cast("long") % 5000).alias("tokens"),
        F.col("o_orderpriority").alias("stage"), (F.expr("o_orderkey div 3") % 12).alias("video_id"), F.col("o_custkey").alias("cust"),
    )


AT = """att AS (SELECT o_orderkey // 3 AS uid, CAST(o_orderkey % 3 AS INTEGER) AS attempt,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'timeout' ELSE 'error' END AS status,
  (['A','B','C','D','E','x',''])[o_orderkey * 7 % 11 % 7 + 1] AS pred, (['A','B','C','D','E'])[(o_orderkey // 3) % 5 + 1] AS gold,
  o_totalprice / 1000 AS elapsed_sec, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS tokens, o_orderpriority AS stage,
  (o_orderkey // 3) % 12 AS video_id, o_custkey AS cust FROM orders)"""
