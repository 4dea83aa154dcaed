"""Series: windows over time, peaks, robust scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(value: str, width: int, keys: list[str], order: list[str]) -> Column:
    """A centred mean over ``width`` rows, padded with zeros at the edges: the sum is divided by ``width``."""
    a, b = width // 2, width - 1 - width // 2
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-a, b)
    return F.sum(value).over(w) / width


def local_maximum(value: str, keys: list[str], order: list[str]) -> Column:
    """At least the row before, above the row after; rows at the ends aren't peaks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce((F.col(value) >= F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)), F.lit(False))


def min_max(value: str, keys: list[str]) -> Column:
    """Scaled to [0, 1] in its partition; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo <= 1e-12, 1.0).otherwise((F.col(value) - lo) / (hi - lo))


def sliding_windows(n: Column, size: int, stride: int, duration: Column) -> Column:
    """(first, stop) frame ranges: full windows, then a tail window if the duration goes on beyond the last frame."""
    n = n.cast("int")
    last = F.greatest(F.lit(0), F.floor((n - size) / stride)).cast("int") * stride
    full = F.when(n >= size, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.struct(s.alias("first"), (s + size).alias("stop"))))
    short = F.array(F.struct(F.lit(0).alias("first"), n.alias("stop")))
    tail = F.when((n >= size) & (duration > n) & (last + stride < n), F.array(F.struct((last + stride).alias("first"), n.alias("stop")))).otherwise(F.slice(short, 1, 0))
    return F.when(n <= 0, F.slice(short, 1, 0)).when(n < size, short).otherwise(F.concat(full, tail))


def fixed_windows(duration: Column, size: int) -> Column:
    """(start, stop) with inclusive stops, from 0 on while start <= whole seconds of the duration."""
    d = F.floor(duration).cast("int")
    return F.transform(F.sequence(F.lit(0), d, F.lit(size)), lambda s: F.struct(s.alias("start"), F.least(s + size - 1, d).alias("stop")))


def robust_scale(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """med, mad, and scaled = max(0, (x - med) / (1.4826 mad + 1e-8)) per partition of the keys."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    x = df.join(med, keys)
    mad = x.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    return x.join(mad, keys).withColumn("scaled", F.greatest(F.lit(0.0), (F.col(value) - F.col("med")) / (1.4826 * F.col("mad") + 1e-8)))
