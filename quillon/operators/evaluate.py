"""Evaluation of per-question attempts: completion, retries, paired comparisons, roll-ups.

Missing is not zero: rates over a fixed population count what is missing as incorrect,
rates over completed rows leave it out, and sums of nothing stay null where told so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_complete(status: str = "status", pred: str = "pred") -> Column:
    return F.coalesce((F.col(status) == "success") & F.col(pred).rlike("^[A-E]$"), F.lit(False))


def status_class(status: str = "status", error: str | None = None) -> Column:
    s = F.lower(F.coalesce(F.col(status), F.lit("")))
    return F.when(s == "success", "success").when(s.contains("timeout"), "timeout").when(s != "", "error").otherwise("missing")


#: Error types by the first token that a message contains.
ERROR_TOKENS = (("oom", ("out of memory", "oom")), ("cuda", ("cuda",)), ("http", ("http", "connection", "429")), ("parse", ("json", "parse")))


def error_type(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(m == "", "none")
    for name, tokens in ERROR_TOKENS:
        hit = m.contains(tokens[0])
        for t in tokens[1:]:
            hit = hit | m.contains(t)
        out = out.when(hit, name)
    return out.otherwise("other")


def retry_merge(attempts: DataFrame, key: str = "uid") -> DataFrame:
    """One row per key: the first attempt if strict, else the first strict retry, else the last attempt made."""
    strict = strict_complete()
    w = Window.partitionBy(key).orderBy(F.desc(strict), F.when(strict, F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def paired(df: DataFrame, key: str, arm: str, a, b, correct: str) -> DataFrame:
    """key, a, b: the two arms side by side by one aggregate, no self-join."""
    return (
        df.where(F.col(arm).isin(a, b)).groupBy(key)
        .agg(F.max(F.when(F.col(arm) == a, F.col(correct).cast("int"))).alias("a"), F.max(F.when(F.col(arm) == b, F.col(correct).cast("int"))).alias("b"))
        .where("a is not null and b is not null")
    )


def paired_table(p: DataFrame, keys: list[str] | None = None) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("a") == 1, F.col("b") == 1
    return p.groupBy(*(keys or [])).agg(n(a & b).alias("both"), n(a & ~b).alias("left_only"), n(~a & b).alias("right_only"), n(~a & ~b).alias("neither"))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def coverage_violations(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, violation: missing, unexpected or duplicate."""
    e, f = expected.groupBy(key).agg(F.count("*").alias("_e")), found.groupBy(key).agg(F.count("*").alias("_f"))
    j = e.join(f, key, "full")
    v = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_f") > 1, "duplicate")
    return j.select(key, v.alias("violation")).where("violation is not null")
