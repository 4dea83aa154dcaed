"""Queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir
from ..streaming import guards as G
from ..streaming import journal as J
from .evidence_queries import _journal
from .fixtures import table
from .registry import query


def _stream(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    base = f"{work_dir(spark)}/quillon/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).parquet(f"{base}/in"), f"{base}/out-{uuid.uuid4().hex}"


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """All windows, with the complete mode's last batch."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    s, out = _stream(spark, e)
    return J.run_once(spark, J.windowed(s), "complete", out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 3 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    s, out = _stream(spark, e)
    r = J.run_once(spark, J.sessions(s), "complete", out)
    return r.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT event_id % 4000 AS charge_id, 1::BIGINT AS n FROM events GROUP BY 1")
def stream_charge_once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 4000).alias("charge_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    s, out = _stream(spark, e)
    return J.run_once(spark, J.charged_once(s), "append", out).groupBy("charge_id").agg(F.count("*").alias("n"))


@query()
def stream_journal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Equal to journal_replay; see the tests."""
    j = _journal(spark, d).select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("attempt").cast("string")).alias("key"), F.col("event_id").alias("seq"), "state")
    s, out = _stream(spark, j)
    return J.run_once(spark, J.replay_stream(s), "update", out, ["key"])


@query("WITH x AS (SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, event_type FROM events), w AS (SELECT h - INTERVAL (k * 6) HOUR AS s, event_type FROM (SELECT time_bucket(INTERVAL 6 HOUR, h, TIMESTAMP '1970-01-01 00:00:00') AS h, event_type FROM x), range(4) r(k)) SELECT CAST(s AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day, one every six hours."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    s, out = _stream(spark, e)
    r = J.run_once(spark, J.windowed(s, "1 day", "6 hours"), "complete", out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH o AS (SELECT o_custkey AS account, o_orderkey // 2 AS charge_id, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(amount) OVER (PARTITION BY account ORDER BY seq) AS spent FROM o)
SELECT account, charge_id, round(spent, 4) AS spent, spent <= 300000 AS within FROM r""")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The budget ledger as a stream: charges once, with each account's running sum."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.expr("o_orderkey div 2").alias("charge_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"))
    s, out = _stream(spark, o)
    return J.run_once(spark, G.ledger(s, 300_000.0), "append", out).select("account", "charge_id", F.round("spent", 4).alias("spent"), "within")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events of users as journals of attempts, each user a case: an attempt begins with a signup, and so on."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", G.BEGIN), ("view", "response_saved"), ("click", "validated"), ("purchase", "checkpointed"), ("error", "technical_failure")) for x in p]), F.col("event_type"))
    return e.select(F.col("user_id").alias("case_id"), F.lit("answer").alias("stage"), F.floor(F.col("event_id") / 2500).cast("long").alias("attempt"), kind.alias("event"), F.col("event_id").alias("seq"), "at")


@query()
def stream_attempt_guard(spark: SparkSession, d: str) -> DataFrame:
    """Attempts that are made at most once, with refusals and timers; tested against a plain version, split into runs."""
    s, out = _stream(spark, _attempts(spark, d))
    return J.run_once(spark, G.guarded(s, 3600), "append", out)


@query("""WITH e AS (SELECT user_id || '/' || CAST(ts AS DATE) AS task, event_type, (epoch_us(ts) // 1000) AS ms FROM events), s AS (SELECT task, min(ms) AS ms FROM e WHERE event_type = 'signup' GROUP BY task),
f AS (SELECT s.task, s.ms, min(e.ms) AS done FROM s LEFT JOIN e ON e.task = s.task AND e.event_type = 'purchase' AND e.ms >= s.ms GROUP BY ALL)
SELECT task, CASE WHEN done < ms + 7200000 THEN 'finished' ELSE 'timeout' END AS state, CASE WHEN done < ms + 7200000 THEN done ELSE ms + 7200000 END AS at_ms FROM f
WHERE done IS NOT NULL OR ms + 7200000 <= (SELECT max((epoch_us(ts) // 1000)) FROM events WHERE event_type IN ('signup', 'purchase'))""")
def stream_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks (a user's day) that begin with a signup and have two hours until a purchase."""
    e = table(spark, d, "events").where("event_type in ('signup', 'purchase')")
    task = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    s, out = _stream(spark, e.select(task.alias("task"), F.when(F.col("event_type") == "signup", "start").otherwise("finish").alias("event"), F.col("ts").cast("timestamp").alias("at")))
    return J.run_once(spark, G.task_ends(s, 7200), "append", out)


@query("SELECT item_id, length(text) AS n, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM benchmark")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Files that came since are worked on by the second run alone."""
    base = f"{work_dir(spark)}/quillon/resume-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark").select("item_id", "text")
    for run, part in ((1, b.where("item_id % 3 = 0")), (2, b.where("item_id % 3 <> 0"))):
        part.write.mode("append").parquet(f"{base}/in")
        work = lambda x, run=run: x.select("item_id", F.char_length("text").cast("long").alias("n"), F.lit(run).alias("run"))
        rows = G.resumed(spark, f"{base}/in", "item_id long, text string", f"{base}/out", work, f"{base}/state")
    return rows
