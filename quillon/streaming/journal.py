"""Streams: replay of an append-only journal, charge-once ledgers, windows over late data.

The batch operators define what is right.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import TRANSITIONS
from .guards import bucket, in_order, packed, started, unpacked

_LEGAL = frozenset(TRANSITIONS)
_FINAL = ("checkpointed", "technical_failure")
OUT = "key string, last_state string, n_events long, n_illegal long, unfinished boolean"
_STANDING = pa.schema({"key": pa.string(), "last": pa.string(), "n": pa.int64(), "bad": pa.int64()})


def _replay(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    standing = {key: (last, n, bad) for key, last, n, bad in unpacked(bytes(state.get[0]))} if state.exists else {}
    touched = {}
    for key, s in in_order(batches, ["key", "state"], ["seq"]):
        last, n, bad = standing.get(key, ("", 0, 0))
        standing[key] = touched[key] = s, n + 1, bad + ((last, s) not in _LEGAL)
    state.update((packed([(key, *v) for key, v in standing.items()], _STANDING),))
    yield pd.DataFrame([(key, last, n, bad, last not in _FINAL) for key, (last, n, bad) in touched.items()], columns=[c.split()[0] for c in OUT.split(", ")])


def replay_stream(events: DataFrame) -> DataFrame:
    """The newest standing of every attempt. ``events`` has key, seq, state; a key's events arrive in order of seq across batches."""
    own = events.select(bucket("key"), "key", "seq", "state")
    return own.groupBy("bucket").applyInPandasWithState(_replay, OUT, "rows binary", "update", GroupStateTimeout.NoTimeout)


def charged_once(charges: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each charge_id once within the watermark on ``at``."""
    return charges.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["charge_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """Counts and sums per event_type in tumbling or sliding windows of ``ts``, less what comes after the watermark."""
    w = F.window("ts", size, slide or size)
    g = events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "3 hours", watermark: str = "1 day") -> DataFrame:
    """Sessions of users that end after a gap without events."""
    g = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Process all that is available through Parquet files and return the rows.

    In append mode that is all rows; in complete mode the last batch; in update mode the newest row of each of ``keys``.
    """
    out = f"{checkpoint}/rows"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True)
    if mode == "append":
        with started(spark):
            q = w.format("parquet").option("path", out).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{batch}")  # a batch that is tried again replaces itself

    w.foreachBatch(save).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/*")
    if mode == "complete":
        return rows.where(F.col("_batch") == (rows.agg(F.max("_batch")).first()[0] or 0)).drop("_batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*").select(*stream.columns)


def with_timeout(starts: DataFrame, seconds: int) -> DataFrame:
    """task, state (running, finished or timeout) of tasks (task, event: start or finish), by processing time.

    A task that isn't finished ``seconds`` after its start was seen times out, and stays so: a later finish changes nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "running"
        if state.hasTimedOut:
            now = "timeout" if now == "running" else now
        elif now == "running" and any((b["event"] == "finish").any() for b in batches):
            now = "finished"
        state.update((now,))
        if now == "running":
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"task": [key[0]], "state": [now]})

    return starts.groupBy("task").applyInPandasWithState(run, "task string, state string", "state string", "update", GroupStateTimeout.ProcessingTimeTimeout)
