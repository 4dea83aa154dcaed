"""Streams that remember: a ledger that charges once, attempts that are made once, tasks that time out.

Each keeps its own named state (values, timers) in the checkpoint, so a query that stops goes on where it was. The state store must be able to hold such
state: ``started`` sees to it. Keys are dealt to buckets, and the keys of a bucket share a call and a value of the state, which a batch reads and writes only
if it has rows of the bucket: calls and exchanges with the store are counted by buckets, not by keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import TRANSITIONS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def started(spark: SparkSession):
    """While a stream starts, sessions use a state store for named state; what was set before comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


# -- buckets ---------------------------------------------------------------------------

#: Buckets that keys are dealt to. A checkpoint holds on to the number it began with.
BUCKETS = 1024


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows as an Arrow stream."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns), strict=True))


class _Held:
    """Rows of a bucket in one value of its state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, **columns: pa.DataType):
        self.schema, self.value = pa.schema(columns), handle.getValueState(name, "rows binary")

    def get(self) -> list[tuple]:
        held = self.value.get()
        return [] if held is None else unpacked(bytes(held[0]))

    def put(self, rows: list[tuple]) -> None:
        self.value.update((packed(rows, self.schema),))


class _Alarm:
    """The earliest time that something of a bucket is due, as one timer; earlier ones that nothing needs any more do no harm."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.value = handle, handle.getValueState("alarm", "at long")

    def at(self, due: int | None, rung: bool = False) -> None:
        held = None if rung else self.value.get()
        if due is not None and (held is None or due < held[0]):
            self.handle.registerTimer(due)
            self.value.update((due,))
        elif rung:
            self.value.clear()


def in_order(rows: Iterator[pd.DataFrame], columns: list[str], by: list[str], **how: object) -> Iterator[tuple]:
    """Tuples of ``columns``; nulls are None."""
    all_ = pd.concat(list(rows)).sort_values(by, kind="stable", **how)[columns]
    return zip(*(c.astype(object).where(c.notna(), None).tolist() if c.hasnans else c.tolist() for _, c in all_.items()), strict=True)


def _whole(x: float | None) -> int | None:
    return None if x is None else int(x)


# -- ledger --------------------------------------------------------------------------

LEDGER = "account long, charge_id long, seq long, spent double, within boolean"


class Ledger(StatefulProcessor):
    """Of a bucket's accounts: what each has spent, and the charges that it knows, which are forgotten after ``keep_ms``."""

    def __init__(self, budget: float, keep_ms: int | None):
        self.budget, self.keep = budget, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = _Held(handle, "spent", account=pa.int64(), spent=pa.float64())
        self.known = _Held(handle, "charges", account=pa.int64(), charge_id=pa.int64(), at_ms=pa.int64())

    def _fresh(self, now: int) -> dict[tuple, int]:
        return {(a, c): at for a, c, at in self.known.get() if self.keep is None or at + self.keep > now}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.keep is None else timerValues.getCurrentProcessingTimeInMs()
        spent, known = dict(self.spent.get()), self._fresh(now)
        out = []
        for account, charge, seq, amount in in_order(rows, ["account", "charge_id", "seq", "amount"], ["seq", "charge_id"]):
            account, charge = _whole(account), _whole(charge)
            if (account, charge) in known:
                continue
            known[account, charge] = now
            own = spent[account] = spent.get(account, 0.0) + (float("nan") if amount is None else amount)
            out.append((account, charge, seq, own, own <= self.budget))
        self.spent.put(list(spent.items()))
        self._keep(known, now)
        yield pd.DataFrame(out, columns=["account", "charge_id", "seq", "spent", "within"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._keep(self._fresh(now), now)
        yield pd.DataFrame([], columns=["account", "charge_id", "seq", "spent", "within"])

    def _keep(self, known: dict[tuple, int], now: int) -> None:
        self.known.put([(a, c, at) for (a, c), at in known.items()])
        if self.keep is not None and now in known.values():
            self.handle.registerTimer(now + self.keep)

    def close(self) -> None:
        pass


def ledger(charges: DataFrame, budget: float, keep_ms: int | None = None) -> DataFrame:
    """account, charge_id, seq, spent, within: each charge once, at its first row, with its account's running sum and whether the budget holds it.

    ``charges`` has account, charge_id, seq, amount; an account's rows arrive in order of seq, split into batches in any way. A charge that comes again
    changes nothing, within ``keep_ms`` milliseconds of processing time if that is given.
    """
    mode = "None" if keep_ms is None else "ProcessingTime"
    own = charges.select(bucket("account"), F.col("account").cast("long"), F.col("charge_id").cast("long"), F.col("seq").cast("long"), F.col("amount").cast("double"))
    return own.groupBy("bucket").transformWithStateInPandas(Ledger(budget, keep_ms), LEDGER, "Append", mode)


# -- attempts ------------------------------------------------------------------------

ATTEMPTS = "case_id long, stage string, attempt long, event string, seq long, state string, refusal string"
#: The event that asks for an attempt to be made; others are the states that follow.
BEGIN = "begin"
_FINAL = "checkpointed"
_FOLLOWS = frozenset(TRANSITIONS) | {("technical_failure", _FINAL)}


class Attempts(StatefulProcessor):
    """Of a bucket's cases: the state of every attempt, and a timer for the first that was sent and is not answered in time."""

    def __init__(self, answer_ms: int):
        self.answer = answer_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = _Held(handle, "attempts", case_id=pa.int64(), stage=pa.string(), attempt=pa.int64(), state=pa.string(), due=pa.int64(), seq=pa.int64())
        self.alarm = _Alarm(handle)

    def _kept(self, states: dict[tuple, tuple], rung: bool = False) -> None:
        self.states.put([(*at, *v) for at, v in states.items()])
        self.alarm.at(min((due for state, due, _ in states.values() if state == "sent"), default=None), rung)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = {(c, s, n): tuple(v) for c, s, n, *v in self.states.get()}
        unsettled: dict = {}  # of each case, the attempts whose outcome is open: hardly ever more than one
        for (case, stage, attempt), v in states.items():
            if v[0] != _FINAL:
                unsettled.setdefault(case, set()).add((stage, attempt))
        out = []
        for case, stage, attempt, event, seq, ms in in_order(rows, ["case_id", "stage", "attempt", "event", "seq", "ms"], ["seq"]):
            case, attempt, seq = _whole(case), int(attempt), int(seq)
            at = case, stage, attempt
            now = states[at][0] if at in states else None
            if event == BEGIN:
                # an attempt is made at most once, and none while an earlier one's outcome is open
                first = None if now else min(unsettled.get(case, ()), default=None)
                refusal = f"exists: {now}" if now else f"unfinished: {first[0]}/{first[1]}={states[case, *first][0]}" if first else None
                state = now if refusal else "sent"
            else:
                refusal = None if (now or "", event) in _FOLLOWS else f"{event} after {now or 'nothing'}"
                state = now if refusal else event
            if not refusal:
                states[at] = state, int(ms) + self.answer, seq
                (unsettled.setdefault(case, set()).discard if state == _FINAL else unsettled.setdefault(case, set()).add)((stage, attempt))
            out.append((case, stage, attempt, event, seq, state, refusal))
        self._kept(states)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        states = {(c, s, n): tuple(v) for c, s, n, *v in self.states.get()}
        out = []
        for at, (state, due, seq) in states.items():
            if state == "sent" and due < now:
                # nobody knows whether the call was made: it stays open and blocks the case until it is settled
                states[at] = "ambiguous", due, seq
                out.append((*at, "timer", seq, "ambiguous", None))
        self._kept(states, rung=True)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

    def close(self) -> None:
        pass


def guarded(events: DataFrame, answer_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """case_id, stage, attempt, event, seq, state, refusal: what each event of a journal changes.

    ``events`` has case_id, stage, attempt, event, seq and at (a timestamp). ``begin`` makes an attempt, which is then sent: it is refused if the attempt
    exists, or if any attempt of the case isn't checkpointed. Other events are states; one that can't follow is refused and changes nothing. An attempt
    that is ``answer_seconds`` behind the watermark without an answer becomes ambiguous and blocks its case.
    """
    ms = (F.unix_micros("at") / 1000).cast("long").alias("ms")
    own = events.withWatermark("at", watermark).select(bucket("case_id"), F.col("case_id").cast("long"), "stage", "attempt", "event", "seq", "at", ms)
    return own.groupBy("bucket").transformWithStateInPandas(Attempts(answer_seconds * 1000), ATTEMPTS, "Append", "EventTime")


# -- tasks ---------------------------------------------------------------------------

TASKS = "task string, state string, at_ms long"


class Tasks(StatefulProcessor):
    """Of a bucket's tasks: when each began, and that it is over. A timer ends the first that is due."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begun = _Held(handle, "begun", task=pa.string(), ms=pa.int64(), over=pa.bool_())
        self.alarm = _Alarm(handle)

    def _kept(self, begun: dict[str, tuple], rung: bool = False) -> None:
        self.begun.put([(task, *v) for task, v in begun.items()])
        self.alarm.at(min((ms + self.limit for ms, over in begun.values() if not over), default=None), rung)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = {task: (ms, over) for task, ms, over in self.begun.get()}
        out = []
        for task, event, ms in in_order(rows, ["task", "event", "ms"], ["ms", "event"], ascending=[True, False]):
            own = begun.get(task)
            if event == "start" and own is None:
                begun[task] = int(ms), False
            elif event == "finish" and own is not None and not own[1]:
                due = own[0] + self.limit
                begun[task] = own[0], True
                out.append((task, "finished", int(ms)) if ms < due else (task, "timeout", due))
        self._kept(begun)
        yield pd.DataFrame(out, columns=["task", "state", "at_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        begun = {task: (ms, over) for task, ms, over in self.begun.get()}
        late = [(task, ms) for task, (ms, over) in begun.items() if not over and ms + self.limit < now]
        begun |= {task: (ms, True) for task, ms in late}
        self._kept(begun, rung=True)
        yield pd.DataFrame([(task, "timeout", ms + self.limit) for task, ms in late], columns=["task", "state", "at_ms"])

    def close(self) -> None:
        pass


def task_ends(events: DataFrame, seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """task, state (finished or timeout), at_ms: the one end of each task whose end is known.

    ``events`` has task, event (start or finish) and at. A task times out ``seconds`` after its first start, once the watermark is there or a later finish shows it; what
    comes after its end, or before any start, changes nothing.
    """
    own = events.withWatermark("at", watermark).select(bucket("task"), "task", "event", "at", (F.unix_micros("at") / 1000).cast("long").alias("ms"))
    return own.groupBy("bucket").transformWithStateInPandas(Tasks(seconds * 1000), TASKS, "Append", "EventTime")


# -- resumed work ----------------------------------------------------------------------


def resumed(spark: SparkSession, source: str, schema: str, target: str, work: Callable[[DataFrame], DataFrame], state: str) -> DataFrame:
    """Works on the files below ``source`` that no earlier call with the same ``state`` folder has finished, and returns all rows in ``target``.

    The files that are done stand in the checkpoint, and each batch's rows appear in ``target`` at once and once, also if a call is cut off and made again.
    """
    stream = work(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
