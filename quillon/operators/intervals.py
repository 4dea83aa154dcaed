"""Operators over half-open intervals ``[start, end)`` in double seconds.

A key (video, user) parts the intervals; nothing crosses keys. Columns are named start_sec
and end_sec. Where ends touch, half-open intervals don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Ordered, previous

S, E = "start_sec", "end_sec"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- predicates and scalars -----------------------------------------------------


def overlaps(a0, a1, b0, b1) -> Column:
    return (c(a0) < c(b1)) & (c(a1) > c(b0))


def overlaps_closed(a0, a1, b0, b1) -> Column:
    """Touching ends count."""
    return ~((c(a1) < c(b0)) | (c(b1) < c(a0)))


def overlap_seconds(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(c(a1), c(b1)) - F.greatest(c(a0), c(b0)))


def distance(a0, a1, b0, b1) -> Column:
    """0 for intervals that overlap or touch, else the gap between them."""
    return F.greatest(F.lit(0.0), c(b0) - c(a1), c(a0) - c(b1))


def point_distance(t, a0, a1) -> Column:
    """0 inside, else the distance to the nearer end."""
    return F.when((c(a0) <= c(t)) & (c(t) < c(a1)), 0.0).otherwise(F.least(F.abs(c(t) - c(a0)), F.abs(c(t) - c(a1))))


def widened(a0, a1, least: float, duration) -> tuple[Column, Column]:
    """At least ``least`` seconds wide about the middle, moved inside [0, duration]."""
    a0, a1, duration = c(a0), c(a1), c(duration)
    wide = a1 - a0 >= least
    mid = (a0 + a1) / 2
    room = F.least(F.lit(float(least)), duration)
    start = F.greatest(F.lit(0.0), F.least(mid - room / 2, duration - room))
    return F.when(wide, F.greatest(F.lit(0.0), a0)).otherwise(start), F.when(wide, F.least(a1, duration)).otherwise(start + room)


#: Seconds of context before and after an interval, by the temporal relation asked for.
PADDING = {"before": (10.0, 0.0), "after": (0.0, 10.0), "during": (2.0, 2.0)}


def expanded(a0, a1, relation) -> tuple[Column, Column]:
    before, after = F.lit(0.0), F.lit(0.0)
    for name, (b, a) in PADDING.items():
        before = F.when(c(relation) == name, F.lit(b)).otherwise(before)
        after = F.when(c(relation) == name, F.lit(a)).otherwise(after)
    return F.greatest(F.lit(0.0), c(a0) - before), c(a1) + after


def clipped_state(r0, r1, p0, p1, eps: float = 1e-6) -> Column:
    """excluded, clipped or valid: a segment against the window it was found in."""
    outside = (c(r1) <= c(p0) + eps) | (c(r0) >= c(p1) - eps)
    return F.when(outside, "excluded").when((c(r0) < c(p0) - eps) | (c(r1) > c(p1) + eps), "clipped").otherwise("valid")


# -- sets of intervals ----------------------------------------------------------


def with_islands(df: DataFrame, keys: list[str], max_gap: float = 0.0, start: str = S, end: str = E, tie: str = "id") -> DataFrame:
    """Numbers islands per key: a row starts one if it begins more than ``max_gap`` after all before it ended."""
    new = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + max_gap), 1).otherwise(0)
    o = Ordered(df, keys, [start, end, tie]).running("_before", end, "max").with_column("_new", new)
    return o.running("island", "_new", "sum", inclusive=True).rows().drop("_before", "_new")


def merged(df: DataFrame, keys: list[str], max_gap: float = 0.0, start: str = S, end: str = E, tie: str = "id") -> DataFrame:
    """keys, start, end, n_sources of the merged intervals."""
    return (
        with_islands(df, keys, max_gap, start, end, tie)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_sources"))
        .drop("island")
    )


def union_duration(df: DataFrame, keys: list[str], start: str = S, end: str = E, tie: str = "id") -> DataFrame:
    """The measure of the union per key, by a running maximum of ends."""
    x = Ordered(df, keys, [start, end, tie]).running("_before", end, "max").rows()
    own = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce("_before", F.col(start))))
    return x.withColumn("_own", own).groupBy(*keys).agg(F.sum("_own").alias("union_seconds"))


def gaps(merged_df: DataFrame, keys: list[str], start: str = S, end: str = E) -> DataFrame:
    """What lies between merged intervals: gap_start, gap_end."""
    nxt = previous(Ordered(merged_df, keys, [start]), "gap_end", start, reverse=True).rows()
    return nxt.where(F.col("gap_end").isNotNull()).select(*keys, F.col(end).alias("gap_start"), "gap_end")


#: Seconds of a time bucket; pairs meet by key and bucket, so a hot key is split by time.
BUCKET = 21_600.0


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float = BUCKET, how: str = "inner", closed: bool = False) -> DataFrame:
    """Pairs that overlap; columns of ``right`` end in ``_r``. With ``closed`` touching ends count.

    Both sides are dealt to time buckets of ``width`` seconds besides the
    keys; a pair counts in the first bucket that both touch. ``how`` is inner or left; left
    keeps the rows of ``left`` that overlap nothing, with nulls (rows are told apart by all their values, so repeated rows are kept as such).
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such interval join: {how}")
    r = right.select(*[F.col(x).alias(x if x in keys else f"{x}_r") for x in right.columns])
    hit = (overlaps_closed if closed else overlaps)(S, E, f"{S}_r", f"{E}_r")
    lb = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(S), width), _bucket(F.greatest(S, E), width))))
    rb = r.withColumn("_b", F.explode(F.sequence(_bucket(F.col(f"{S}_r"), width), _bucket(F.greatest(f"{S}_r", f"{E}_r"), width))))
    met = lb.join(rb, [*keys, "_b"]).where(hit & (F.col("_b") == _bucket(F.greatest(F.col(S), F.col(f"{S}_r")), width))).drop("_b")
    met = met.select(*left.columns, *[c for c in r.columns if c not in keys])
    if how == "inner":
        return met
    same = None
    found = met.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    for c in left.columns:
        one = left[c].eqNullSafe(found[f"_{c}"])
        same = one if same is None else same & one
    alone = left.join(found, same, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def points_in(spans: DataFrame, points: DataFrame, keys: list[str], time: str = "t", width: float = BUCKET, start: str = S, end: str = E, closed: str = "left") -> DataFrame:
    """Pairs of a span and a point ``time`` in it. ``closed`` says which ends belong to the span: left, both or neither."""
    ok = {"left": lambda t: (t >= F.col(start)) & (t < F.col(end)), "both": lambda t: t.between(F.col(start), F.col(end)), "neither": lambda t: (t > F.col(start)) & (t < F.col(end))}[closed]
    sb = spans.withColumn("_b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.greatest(start, end), width))))
    return sb.join(points.withColumn("_b", _bucket(F.col(time), width)), [*keys, "_b"]).where(ok(F.col(time))).drop("_b")


def clip_to_best(items: DataFrame, windows: DataFrame, keys: list[str], width: float = BUCKET) -> DataFrame:
    """Each item cut to the window that it overlaps most; ties go to the later start, then the later end. Items without one go."""
    met = interval_join(items, windows, keys, width).withColumn("ov", overlap_seconds(S, E, f"{S}_r", f"{E}_r"))
    best = met.groupBy(*keys, "id", S, E).agg(F.max(F.struct("ov", f"{S}_r", f"{E}_r")).alias("_w"))
    return best.select(
        *keys, "id", F.greatest(F.col(S), F.col(f"_w.{S}_r")).alias("clip_start"), F.least(F.col(E), F.col(f"_w.{E}_r")).alias("clip_end"),
        F.col(S).alias("source_start"), F.col(E).alias("source_end"),
    )


def cover_ratio(items: DataFrame, covers: DataFrame, keys: list[str], width: float = BUCKET) -> DataFrame:
    """Sum of overlaps over the duration, at most 1, and 0 for an item without duration; overlapping covers count twice."""
    met = interval_join(items, covers, keys, width).groupBy(*keys, "id").agg(F.sum(overlap_seconds(S, E, f"{S}_r", f"{E}_r")).alias("_s"))
    long = F.col(E) - F.col(S)
    ratio = F.when(long > 0, F.least(F.lit(1.0), F.coalesce(F.col("_s"), F.lit(0.0)) / long)).otherwise(0.0)
    return items.join(met, [*keys, "id"], "left").select(*keys, "id", ratio.alias("ratio"))


def subtracted(items: DataFrame, cuts: DataFrame, keys: list[str], width: float = BUCKET) -> DataFrame:
    """What is left of the items without the cuts: each item less the merged cuts that overlap it."""
    met = interval_join(items, merged(cuts, keys), keys, width)
    own = met.groupBy(*keys, "id", S, E).agg(F.array_sort(F.collect_list(F.struct(F.col(f"{S}_r").alias("s"), F.col(f"{E}_r").alias("e")))).alias("_c"))
    n = F.size("_c")
    parts = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, F.col(S)).otherwise(F.get("_c", i - 1)["e"]).alias("left_start"),
            F.when(i == n, F.col(E)).otherwise(F.get("_c", i)["s"]).alias("left_end"),
        ),
    )
    left = own.select(*keys, "id", F.inline(F.filter(parts, lambda p: p["left_start"] < p["left_end"])))
    whole = items.join(own.select(*keys, "id"), [*keys, "id"], "left_anti").where(F.col(S) < F.col(E))
    return left.unionByName(whole.select(*keys, "id", F.col(S).alias("left_start"), F.col(E).alias("left_end")))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value_cols: list[str], valid_until: str | None = None) -> DataFrame:
    """Each left row (id, time) with the last right row at or before it, by one sort and a running last.

    No pairs are formed, and a hot key is scanned by ranges of time. With
    ``valid_until`` the right row counts only while time is before that column.
    """
    extra = [x for x in [valid_until] if x and x not in value_cols]
    cols = [time, *value_cols, *extra]
    r = right.select(*keys, F.col(time), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id"), F.struct(*cols).alias("_v"))
    kind = r.schema["_v"].dataType
    le = left.select(*keys, F.col(time), F.lit(1).alias("_side"), F.col("id").cast("long").alias("id"), F.lit(None).cast(kind).alias("_v"))
    out = Ordered(le.unionByName(r), keys, [time, "_side", "id"]).running("_last", "_v", "last", inclusive=True).rows().where("_side = 1")
    ok = F.lit(True) if valid_until is None else F.col(time) < F.col(f"_last.{valid_until}")
    return out.select(*keys, "id", time, *[F.when(ok, F.col(f"_last.{v}")).alias(v) for v in value_cols])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], width: float = BUCKET) -> DataFrame:
    """Each left interval with the nearest right one: smallest distance, then smallest id.

    What overlaps or touches meets by buckets; else the last end before and the first start after are
    running values of one sort each. No key's pairs are formed, and a hot key is scanned by ranges of time.
    """
    met = interval_join(left, right, keys, width, closed=True).select(*keys, "id", F.lit(0.0).alias("dist"), F.col("id_r").alias("nid"))
    k = [*keys, "id"]

    def beside(time_left: str, time_right: str, after: bool) -> DataFrame:
        # of equal times the smallest id comes last, and left rows after all of them; later times first where rows after are looked for
        at = (lambda t: -F.col(t)) if after else F.col
        r = right.select(*keys, at(time_right).alias("_t"), F.lit(0).alias("_side"), (-F.col("id")).cast("long").alias("_tie"), F.lit(None).cast("long").alias("id"), F.struct(at(time_right).alias("t"), F.col("id").alias("nid")).alias("_v"))
        le = left.select(*keys, at(time_left).alias("_t"), F.lit(1).alias("_side"), F.col("id").cast("long").alias("_tie"), F.col("id").cast("long").alias("id"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
        x = Ordered(le.unionByName(r), keys, ["_t", "_side", "_tie"]).running("_l", "_v", "last", inclusive=True).rows().where("_side = 1 and _l is not null")
        return x.select(*k, F.abs(F.col("_t") - F.col("_l.t")).alias("dist"), F.col("_l.nid").alias("nid"))

    every = met.unionByName(beside(S, E, False)).unionByName(beside(E, S, True))
    best = every.groupBy(*k).agg(F.min(F.struct("dist", "nid")).alias("_b"))
    return best.select(*k, F.col("_b.nid").alias("nearest_id"), F.col("_b.dist").alias("dist"))
