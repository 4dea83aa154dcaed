"""Statistics as expressions and small plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def mcnemar_exact(b: Column, c: Column) -> Column:
    """min(1, 2 sum_{i <= min(b, c)} C(n, i) / 2^n), 1 if n is 0; in logarithms, so any n will do."""
    n, k = b + c, F.least(b, c)
    # one logarithm and one sum go along, whatever the number of terms
    first = n * F.log(F.lit(0.5))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int"))),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda acc, i: F.struct((acc["log"] + F.log((n - i + 1) / i)).alias("log"), (acc["sum"] + F.when(i <= k, F.exp(acc["log"] + F.log((n - i + 1) / i))).otherwise(0.0)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = successes / n, Z95 * Z95
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def erfc(x: Column) -> Column:
    """By the rational fit with a relative error below 1.2e-7."""
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1 / (1 + 0.5 * F.abs(x))
    poly: Column = F.lit(coef[-1])
    for a in reversed(coef[:-1]):
        poly = F.lit(a) + t * poly
    y = t * F.exp(-x * x + poly)
    return F.when(x >= 0, y).otherwise(2 - y)


def wilcoxon(diffs: DataFrame, keys: list[str], diff: str = "d") -> DataFrame:
    """n, w_plus, z, p of the signed rank test: zeros go, ties share ranks, tie and continuity corrections."""
    x = diffs.where(F.col(diff) != 0).withColumn("_a", F.abs(diff))
    w = Window.partitionBy(*keys).orderBy("_a")
    tie = Window.partitionBy(*keys, "_a")
    x = x.withColumn("_t", F.count("*").over(tie)).withColumn("_r", F.rank().over(w) + (F.col("_t") - 1) / 2)
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0)).alias("w_plus"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"),  # sum over rows of t^2 - 1 is sum over ties of t^3 - t
    )
    n = F.col("n")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    dev = F.col("w_plus") - mean
    z = F.when(var > 0, (dev - F.signum(dev) * 0.5) / F.sqrt(var)).otherwise(0.0)
    return g.select(*keys, "n", "w_plus", z.alias("z"), F.when(z == 0, 1.0).otherwise(erfc(F.abs(z) / math.sqrt(2))).alias("p"))


def holm(df: DataFrame, p: str = "p", tie: str = "name") -> DataFrame:
    """Adds p_holm: the running maximum of (m - rank) p in ascending order, at most 1.

    Tests are few; they form one partition.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(p, tie)
    scaled = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, po, pe, kappa of two raters; null where pe is 1. One aggregate of pairs, then marginals of the small table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    ra = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x"))
    rb = cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    pe = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    out = n.crossJoin(pe).select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("xy") / (F.col("n") * F.col("n"))).alias("pe"))
    return out.withColumn("kappa", F.when(F.col("pe") != 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """ordered[ceil(q n) - 1] per key."""
    from ..operators.ranking import ranked

    x = ranked(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    return x.where(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.round(q * F.col("size"), 9)))).select(*keys, F.col(value).alias("nearest_rank"))


def bootstrap_paired(df: DataFrame, diff: str, key: str, replicates: int, seed: int) -> DataFrame:
    """Percentile interval of the mean difference over ``replicates`` resamples.

    Poisson weights by a hash of (seed, replicate, key) stand for the counts that resampling
    would give, so every row draws its own weights, no row is joined to another and one
    aggregate by replicate with map-side sums is all that moves.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("r"), F.col(key)), F.lit(1 << 53)) / float(1 << 53)
    weight: Column = F.lit(0)
    acc, term = 0.0, math.exp(-1)
    for k in range(12):
        acc += term
        weight = weight + F.when(u >= acc, 1).otherwise(0)
        term /= k + 1
    drawn = df.select(key, diff).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col(diff)), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))
