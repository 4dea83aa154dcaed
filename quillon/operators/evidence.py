"""Evidence: roles, relations between candidates, contracts, sufficiency, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import distance, interval_join, overlaps, union_duration


def roles(modality: str, value: str) -> Column:
    """Roles of a candidate, in fixed order."""
    m = F.col(modality)
    return F.array_compact(F.array(
        F.when(m == "click", "trigger"), F.when(m == "view", "response"), F.when(F.col(value) > 50, "anchor"),
        F.when(~m.isin("click", "view"), "supporting"),
    ))


def relations(c: DataFrame, key: str = "video_id", reach: float = 7200.0) -> DataFrame:
    """source_id, target_id, relation_type, gap among the candidates of a video within ``reach`` seconds.

    response_to: a response starts at or after a trigger's end. alternative_to: two
    responses of one trigger, the smaller id first. overlaps and near: other pairs, smaller id first.
    """
    cols = ["id", "start_sec", "end_sec", "modality"]
    # a candidate widened by the reach overlaps those within it; pairs meet by time buckets
    wide = c.select(key, *cols).withColumns({"start_sec": F.col("start_sec") - reach, "end_sec": F.col("end_sec") + reach})
    p = interval_join(wide, c.select(key, *cols), [key], reach * 4).where("id <> id_r")
    own = {"start_sec": F.col("start_sec") + reach, "end_sec": F.col("end_sec") - reach}
    p = p.select(key, *[own.get(x, F.col(x)).alias(f"a_{x}") for x in cols], *[F.col(f"{x}_r").alias(f"b_{x}") for x in cols])
    responds = (F.col("a_modality") == "view") & (F.col("b_modality") == "click") & (F.col("a_start_sec") >= F.col("b_end_sec"))
    gap = distance("a_start_sec", "a_end_sec", "b_start_sec", "b_end_sec")
    resp = p.where(responds).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.lit("response_to").alias("relation_type"), gap.alias("gap"))
    alt = resp.alias("x").join(resp.alias("y"), "target_id").where("x.source_id < y.source_id").select(
        F.col("x.source_id").alias("source_id"), F.col("y.source_id").alias("target_id"), F.lit("alternative_to").alias("relation_type"), F.abs(F.col("x.gap") - F.col("y.gap")).alias("gap")
    ).groupBy("source_id", "target_id", "relation_type").agg(F.min("gap").alias("gap"))
    touch = p.where(F.col("a_id") < F.col("b_id")).select(
        F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"),
        F.when(overlaps("a_start_sec", "a_end_sec", "b_start_sec", "b_end_sec"), "overlaps").otherwise("near").alias("relation_type"), gap.alias("gap"),
    )
    return resp.unionByName(alt).unionByName(touch)


def resolver_relations(anchors: DataFrame, resolvers: DataFrame, identifies: str, key: str = "video_id", reach: float = 7200.0) -> DataFrame:
    """source_id, target_id, relation_type, gap of anchors and resolvers of a video within ``reach`` seconds.

    overlaps or near goes from the anchor to the resolver; where the anchors' column ``identifies`` holds, resolves goes from the
    resolver to the anchor too. The gap is 0 where they overlap.
    """
    wide = anchors.select(key, "id", (F.col("start_sec") - reach).alias("start_sec"), (F.col("end_sec") + reach).alias("end_sec"), F.col(identifies).alias("_same"))
    p = interval_join(wide, resolvers.select(key, "id", "start_sec", "end_sec"), [key], reach * 4).where("id <> id_r")
    own = [F.col("start_sec") + reach, F.col("end_sec") - reach, F.col("start_sec_r"), F.col("end_sec_r")]
    p = p.select("id", "id_r", "_same", F.when(overlaps(*own), "overlaps").otherwise("near").alias("relation_type"), distance(*own).alias("gap"))
    to = p.select(F.col("id").alias("source_id"), F.col("id_r").alias("target_id"), "relation_type", "gap")
    return to.unionByName(p.where("_same").select(F.col("id_r").alias("source_id"), F.col("id").alias("target_id"), F.lit("resolves").alias("relation_type"), "gap"))


def fallback_relations(c: DataFrame, recovered: Column, missing: int = -1) -> DataFrame:
    """fallback_recovery_for, from every candidate that a fallback brought back to ``missing``, which stands for the evidence that wasn't there."""
    return c.where(recovered).select(F.col("id").alias("source_id"), F.lit(missing).cast("long").alias("target_id"), F.lit("fallback_recovery_for").alias("relation_type"), F.lit(0.0).alias("gap"))


def inverted(r: DataFrame) -> DataFrame:
    """Also the other direction of response_to, as trigger_of."""
    swap = r.where("relation_type = 'response_to'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("trigger_of").alias("relation_type"), "gap")
    return r.unionByName(swap)


def stable(r: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations whose ends exist, each identity once (gap to nine places), and the dangling ones."""
    known = ids.select(F.col("id").alias("_i"))
    ok = r.join(known, F.col("source_id") == F.col("_i"), "left_semi").join(known, F.col("target_id") == F.col("_i"), "left_semi")
    bad = r.join(known, F.col("source_id") == F.col("_i"), "left_anti").unionByName(r.join(known, F.col("source_id") == F.col("_i"), "left_semi").join(known, F.col("target_id") == F.col("_i"), "left_anti"))
    one = ok.withColumn("gap", F.round("gap", 9)).dropDuplicates(["source_id", "target_id", "relation_type", "gap"])
    return one, bad


def sufficiency(c: DataFrame, key: str = "video_id") -> DataFrame:
    """key, status, reasons from what kinds of evidence exist."""
    has = lambda cond: F.coalesce(F.some(cond), F.lit(False))
    g = c.groupBy(key).agg(
        has(F.col("modality") == "click").alias("t"), has(F.col("modality") == "view").alias("r"),
        has(F.col("value") > 90).alias("strong"), F.count("*").alias("n"),
    )
    reasons = F.array_compact(F.array(F.when(~F.col("t"), "no_trigger"), F.when(~F.col("r"), "no_response"), F.when(~F.col("strong"), "weak_scores"), F.when(F.col("n") < 3, "few")))
    status = F.when(F.size("reasons") == 0, "sufficient").when(F.col("t") & F.col("r"), "questionable").otherwise("insufficient")
    return g.withColumn("reasons", reasons).withColumn("status", status).select(key, "status", F.array_join("reasons", ",").alias("reasons"))


def group_violations(groups: DataFrame, retained: DataFrame) -> DataFrame:
    """id, violation: retained entities in no group or in several, members that aren't retained."""
    g = groups.groupBy("id").agg(F.count("*").alias("n"))
    j = retained.select("id").distinct().withColumn("_r", F.lit(1)).join(g, "id", "full")
    v = F.when(F.col("_r").isNull(), "not_retained").when(F.col("n").isNull(), "ungrouped").when(F.col("n") > 1, "several")
    return j.select("id", v.alias("violation")).where("violation is not null")


def budget_violations(retained: DataFrame, key: str, most: int, seconds: float) -> DataFrame:
    """key, n, seconds, over of the packets that break a budget: more than ``most`` entities, or a union of more than ``seconds``.

    Both sides of the comparison are counted on their own: what was retained against what is allowed.
    """
    n = retained.groupBy(key).agg(F.count("*").alias("n"))
    spent = union_duration(retained, [key]).withColumnRenamed("union_seconds", "seconds")
    over = F.array_compact(F.array(F.when(F.col("n") > most, "count"), F.when(F.col("seconds") > seconds, "seconds")))
    return n.join(spent, key).withColumn("over", F.array_join(over, ",")).where("over <> ''")


def state_diff(a: DataFrame, b: DataFrame, key: str, exact: list[str], loose: list[str]) -> DataFrame:
    """key, category: exact, nondeterministic (only loose columns differ), mismatch, missing."""
    x = a.select(key, F.struct(*exact).alias("ae"), F.struct(*loose).alias("al"))
    y = b.select(key, F.struct(*exact).alias("be"), F.struct(*loose).alias("bl"))
    cat = F.when(F.col("ae").isNull() | F.col("be").isNull(), "missing").when(~F.col("ae").eqNullSafe(F.col("be")), "mismatch").when(~F.col("al").eqNullSafe(F.col("bl")), "nondeterministic").otherwise("exact")
    return x.join(y, key, "full").select(key, cat.alias("category"))


def frames_dedup(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One frame per video and millisecond: dense is preferred, then the smaller path; lineage is united."""
    pick = F.min_by("path", F.struct((F.col("provenance") != "dense").alias("z"), "path"))
    return frames.groupBy(*keys).agg(pick.alias("path"), F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("lineage"), F.count("*").alias("n"))


def ranked_order(df: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """Both orders of frames: by selection, and as presented in time, with the distance from the anchor."""
    w = Window.partitionBy(*keys)
    return df.withColumn("selection", F.row_number().over(w.orderBy(F.desc("value"), "id"))).withColumn("position", F.row_number().over(w.orderBy("start_sec", "id"))).withColumn("from_anchor", F.abs(F.col("start_sec") - F.col(anchor)))
