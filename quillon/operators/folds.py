"""Greedy choices that depend on what was chosen before, over rows that pass one by one.

Rows are dealt by key and sorted within the task; a task walks them as a stream and holds what a rule remembers of the rows
taken, never a key's rows. So a key of any number of rows takes constant memory (it is one task's, since each choice depends on those before it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule:
    """Decides row by row. A call gives True to take the row, False to leave it, None if no later row can be taken."""

    def __call__(self, *values: object) -> bool | None:
        raise NotImplementedError

    def drops_last(self) -> bool:
        """After a key's last row: whether the row taken last goes again."""
        return False


class Apart(Rule):
    """At most ``most`` rows whose numbers are at least ``gap`` apart from all taken before."""

    def __init__(self, gap: float, most: int | None = None):
        self.gap, self.most, self.taken = gap, most, []

    def __call__(self, t: float) -> bool | None:
        if self.most is not None and len(self.taken) >= self.most:
            return None
        if t is None or any(abs(y - t) < self.gap for y in self.taken):
            return False
        self.taken.append(t)
        return True


class After(Rule):
    """Rows in ascending order, each ``gap`` or more (``strict``: more) after the one taken last: one number is remembered."""

    def __init__(self, gap: float, strict: bool = False):
        self.gap, self.strict, self.last = gap, strict, None

    def __call__(self, t: float) -> bool:
        ok = self.last is None or (t - self.last > self.gap if self.strict else t - self.last >= self.gap)
        if ok:
            self.last = t
        return ok


class EdgesApart(Rule):
    """At most ``most`` intervals whose edges keep ``gap`` from all taken before."""

    def __init__(self, gap: float, most: int):
        self.gap, self.most, self.taken = gap, most, []

    def __call__(self, s: float, e: float) -> bool | None:
        if len(self.taken) >= self.most:
            return None
        if any(max(a - e, s - b) < self.gap for a, b in self.taken):
            return False
        self.taken.append((s, e))
        return True


class Another(Rule):
    """The first row, and the first after it whose number is ``gap`` away or that is another interval."""

    def __init__(self, gap: float):
        self.gap, self.first, self.done = gap, None, False

    def __call__(self, t: float, s: float, e: float) -> bool | None:
        if self.done:
            return None
        if self.first is None:
            self.first = (t, s, e)
            return True
        self.done = abs(t - self.first[0]) >= self.gap or (s, e) != self.first[1:]
        return self.done


class Segments(Rule):
    """Starts of segments: the first row, and rows whose distance reaches the threshold ``least`` or more after the last start. A short last segment joins the one before."""

    def __init__(self, threshold: float, least: float):
        self.threshold, self.least, self.start, self.now, self.n = threshold, least, None, None, 0

    def __call__(self, t: float, distance: float) -> bool:
        self.now = t
        ok = self.start is None or distance is not None and distance >= self.threshold and t - self.start >= self.least
        if ok:
            self.start, self.n = t, self.n + 1
        return ok

    def drops_last(self) -> bool:
        return self.n > 1 and self.now - self.start < self.least


class Cuts(Rule):
    """Cuts at peaks, and ``most`` rows after the last cut (or the first row) at the latest; the first row is none."""

    def __init__(self, most: int):
        self.most, self.run = most, None

    def __call__(self, peak: bool) -> bool:
        if self.run is None:
            self.run = 0
            return False
        self.run += 1
        if ok := bool(peak) or self.run >= self.most:
            self.run = 0
        return ok


class Budget(Rule):
    """Rows by priority while their kind has room and the union of the intervals taken stays within ``seconds``: disjoint intervals are remembered."""

    def __init__(self, seconds: float, room: dict[str, int], other: int):
        self.seconds, self.room, self.other, self.n, self.spans = seconds, room, other, {}, []

    def __call__(self, kind: str, s: float, e: float) -> bool:
        if self.n.get(kind, 0) >= self.room.get(kind, self.other):
            return False
        # what touches the new interval becomes one with it
        beside = [x for x in self.spans if x[1] < s or x[0] > e]
        near = [x for x in self.spans if not (x[1] < s or x[0] > e)]
        one = (min([s, *(a for a, _ in near)]), max([s, e, *(b for _, b in near)]))
        if sum(b - a for a, b in beside) + one[1] - one[0] > self.seconds:
            return False
        self.spans = [*beside, one]
        self.n[kind] = self.n.get(kind, 0) + 1
        return True


def walked(df: DataFrame, keys: list[str], order: list[str | Column], needs: list[str], rule: Callable[[], Rule], fill: int = 0) -> DataFrame:
    """The rows of ``df`` that a rule takes, with ``pick`` (1, 2, ...): the place of each in its key's choice.

    ``order`` (the last ones unique) is the order in which a key's rows pass; ``needs`` names the columns that the rule is called with. With ``fill``,
    the first rows that it left follow until so many are taken in all. A null key is a key of its own.
    """
    if "pick" in df.columns:
        raise ValueError("a column is named pick already")
    dealt = df.repartition(*keys).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], *order)
    schema = T.StructType([*df.schema.fields, T.StructField("pick", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, n, last, spare, over = object(), None, 0, None, [], True
        ready: list[tuple[pa.RecordBatch, int, int]] = []

        def close() -> None:
            nonlocal n
            if last is not None:
                if own.drops_last():
                    n -= 1
                else:
                    ready.append(last)
            for b, i in spare[: max(0, fill - n)]:
                n += 1
                ready.append((b, i, n))

        def out(b: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            here = [(i, p) for x, i, p in ready if x is b]
            parts = [(x.slice(i, 1), [p]) for x, i, p in ready if x is not b]
            if here:
                parts.append((b.take(pa.array([i for i, _ in here])), [p for _, p in here]))
            for x, p in parts:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(p, pa.int32())], [*x.schema.names, "pick"])
            ready.clear()

        for b in batches:
            key = zip(*(b[k].to_pylist() for k in keys), strict=True)
            values = zip(*(b[c].to_pylist() for c in needs), strict=True)
            for i, (k, v) in enumerate(zip(key, values, strict=True)):
                if k != now:
                    if own is not None:
                        close()
                    now, own, n, last, spare, over = k, rule(), 0, None, [], False
                if over:
                    continue
                took = own(*v)
                if took:
                    if last is not None:
                        ready.append(last)
                    n += 1
                    last = (b, i, n)
                elif took is None:
                    over = True
                elif len(spare) < fill:
                    spare.append((b, i))
            yield from out(b)
            # what may still be wanted of this batch is copied, so that the batch itself can go
            if last is not None and last[0] is b:
                last = (b.take(pa.array([last[1]])), 0, last[2])
            spare = [(x.take(pa.array([i])), 0) if x is b else (x, i) for x, i in spare]
        if own is not None:
            close()
        yield from out(None)

    return dealt.mapInArrow(run, schema)
