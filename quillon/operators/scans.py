"""Running values over the rows of a key in order, also where one key holds most rows.

Rows of an ordinary key are sorted in one task. A key with more than ``HOT_ROWS`` rows is dealt over the cluster by ranges of its
order; each range reduces to a carry (a maximum, a sum, a last value), the carries of a key are scanned, and every range is finished
with what came before it. The ranges are written, since all passes must see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

#: Rows of one key that one task may sort.
HOT_ROWS = 4_000_000
#: Carries that may be broadcast: one for each hot key and range.
BROADCAST_CARRIES = 500_000

#: kind: running value over a window, carry of a range (value, order), combination of carry and own.
_KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "max": (F.max, lambda v, pick: F.max(v), lambda carry, own: F.greatest(carry, own)),
    "sum": (F.sum, lambda v, pick: F.sum(v), lambda carry, own: F.coalesce(carry + own, carry, own)),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda v, pick: pick(v), lambda carry, own: F.coalesce(own, carry)),
}


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_CARRIES + 1).count() <= BROADCAST_CARRIES else df


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_k_{k}"]) for k in columns])


class Ordered:
    """Rows of ``df`` by ``keys`` in ascending ``order`` (columns; the last ones make it total).

    ``running`` adds columns one after the other, ``rows`` gives the table. Keys and order may hold nulls (first in order).
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None):
        self.keys, self.order = keys, order
        most = HOT_ROWS if hot_rows is None else hot_rows
        hot = df.groupBy(*keys).count().where(F.col("count") > most).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        self.parts: list[tuple[DataFrame, list[str]]] = [(df, keys)]
        if not hot.isEmpty():
            hot = written(hot, "hot-keys")
            met = _broadcast(hot)
            n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            own = df.join(met, _same(df, met, keys), "left_semi")
            own = own.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
            self.parts = [(df.join(met, _same(df, met, keys), "left_anti"), keys), (written(own, "ranges"), [*keys, "_range"])]

    def running(self, name: str, value: Column | str, how: str, inclusive: bool = False, reverse: bool = False) -> Ordered:
        """Adds the running ``max``, ``sum`` or ``last`` (that isn't null) of ``value`` over the rows before, and the row itself if ``inclusive``.

        With ``reverse`` it runs over the rows after. Nothing before gives null.
        """
        value = F.col(value) if isinstance(value, str) else value
        run, reduced, join = _KINDS[how]
        done = []
        for df, by in self.parts:
            w = Window.partitionBy(*by).orderBy(*[F.desc(o) if reverse else F.asc(o) for o in self.order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            if by == self.keys:
                done.append((df.withColumn(name, run(value).over(w)), by))
                continue
            place = F.struct(*self.order)
            pick = lambda v, place=place: (F.min_by if reverse else F.max_by)(F.when(v.isNotNull(), v), F.when(v.isNotNull(), place))
            carry = df.groupBy(*by).agg(reduced(value, pick).alias("_carry"))
            before = Window.partitionBy(*self.keys).orderBy(F.desc("_range") if reverse else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
            carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in by], run(F.col("_carry")).over(before).alias("_carry"))
            carry = _broadcast(written(carry, "carries"))
            met = df.withColumn(name, run(value).over(w)).join(carry, _same(df, carry, by), "left")
            done.append((met.select(*[c for c in met.columns if c != name and not c.startswith("_k_") and c != "_carry"], join(F.col("_carry"), F.col(name)).alias(name)), by))
        out = object.__new__(Ordered)
        out.keys, out.order, out.parts = self.keys, self.order, done
        return out

    def with_column(self, name: str, value: Column) -> Ordered:
        """Adds a column made of the row's own."""
        out = object.__new__(Ordered)
        out.keys, out.order, out.parts = self.keys, self.order, [(df.withColumn(name, value), by) for df, by in self.parts]
        return out

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.drop("_range") for df, _ in self.parts])


def previous(rows: Ordered, name: str, value: str, reverse: bool = False) -> Ordered:
    """Adds the value of the row before (after it with ``reverse``), null or not; null at the end."""
    return rows.running(f"_{name}", F.struct(F.col(value).alias("v")), "last", reverse=reverse).with_column(name, F.col(f"_{name}.v"))
