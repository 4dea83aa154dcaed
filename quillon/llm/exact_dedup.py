"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest, one row for each distinct text. A new
batch is reduced to its distinct digests, which meet the index by a sort-merge join whose
index side needs no shuffle; those without a match (the anti-join) are appended with the
same bucketing. Decisions belong to rows and texts, never to ids: a row is kept because its own text is
new and its id is the one that the text keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, free, join_groups, named, one_each, repeated, written


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A persistent table ``(digest, keep_id, batch)``, bucketed and sorted by digest.

    ``buckets`` defaults to ``spark.sql.shuffle.partitions``, the session's own measure of
    its size; a table that exists keeps the number that it was made with. ``batch`` names the
    batch that brought the text in. The caller owns the table; ``drop`` removes it. After many appends a
    bucket has several files, which Spark then sorts again when it merges (but doesn't shuffle).
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(table):
            rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
            self.buckets = int(rows[0]["data_type"])
        else:
            self._append(spark.createDataFrame([], "digest binary, keep_id long, batch string"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .saveAsTable(self.table)
        )

    def add(self, batch: DataFrame, name: str) -> DataFrame:
        """Meet the index with the rows (id, digest) of a batch and append its new texts under ``name``.

        Returns one row for each text of the batch: digest, keep_id, group_size (its rows in
        the batch), fresh. A text that is new keeps the largest id of the batch and is fresh; a text
        that another batch brought in keeps the id recorded there. A batch that comes again under its name,
        as after a failure, finds its own texts fresh with the ids recorded, and appends only
        what the failed attempt left out.
        """
        # written before the join: the optimizer would push it below the aggregate,
        # and then all rows of a text, not one for each task, would meet in one place
        groups = written(batch.groupBy("digest").agg(F.max("id").alias("id"), F.count("*").alias("group_size")), "groups")
        known = self.rows().select("digest", F.col("keep_id").alias("_keep"), F.col("batch").alias("_batch")).hint("merge")
        # one pass over the index: without a match is the anti-join, with one tells the id that stays
        met = written(groups.join(known, "digest", "left"), "met")
        discard(groups)
        self._append(met.where("_batch is null").select("digest", F.col("id").alias("keep_id"), F.lit(name).alias("batch")))
        new = F.col("_batch").isNull()
        out = met.select("digest", F.when(new, F.col("id")).otherwise(F.col("_keep")).alias("keep_id"), "group_size", (new | (F.col("_batch") == name)).alias("fresh"))
        out._met = met
        return out


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """``rows`` in ``n`` parts by falling id, the ones without an id last; so an earlier part's id is larger."""
    if n == 1:
        return [rows]
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(n - 1, 0, -1)], 10_000)).first()[0] or []
    parts, above = [], F.lit(True)
    for c in sorted(set(cuts), reverse=True):
        parts.append(rows.where(above & (F.col("id") > c)))
        above = F.col("id") <= c
    return [*parts, rows.where(above | F.col("id").isNull())]


def decide(rows: DataFrame, index: DigestIndex, name: str, batches: int = 1) -> DataFrame:
    """digest, keep_id, group_size, fresh of every text of ``rows`` (id, digest), which go to the index in ``batches``."""
    found = [index.add(part, f"{name}/{k}") for k, part in enumerate(_batches(rows, batches))]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # a text is fresh in the batch that brought it in; later ones were told the same id
    merged = every.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("fresh").alias("fresh"))
    out = written(merged, "decisions")
    discard(*[f._met for f in found])
    return out


def _decided(docs: DataFrame, id_col: str, text_col: str, table: str | None, batch: str | None, batches: int) -> tuple[DataFrame, DataFrame]:
    rows = written(docs.select(named([id_col])[0].cast("long").alias("id"), digest(named([text_col])[0]).alias("digest")), "digests")
    index = DigestIndex(docs.sparkSession, table or f"quillon_digests_{uuid.uuid4().hex}")
    try:
        return rows, decide(rows, index, batch or uuid.uuid4().hex, batches)
    finally:
        if table is None:
            index.drop()  # all that is needed of it is written


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: str | None = None, batch: str | None = None, batches: int = 1) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest id stays; a text that ``table`` has from
    another batch keeps the id recorded there, and then no row of ``docs`` is kept. Give a batch its own
    name in ``batch``: if it comes again under that name, its rows are decided as before. Without
    ``table`` the index is new and dropped at the end. ``batches`` above 1 send the rows to the index in
    so many batches. Null texts count as empty. Rows with a null id come back with kept false unless a text has only such
    rows; repeated rows with one id are counted each, and all carry the same decision (``survivors`` keeps one of
    them); one id with several texts is decided for each text. An empty table gives no rows. Other columns are not read.
    """
    rows, texts = _decided(docs, id_col, text_col, table, batch, batches)
    met = join_groups(rows, texts, "digest", "group_size", rows.count())
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: str | None = None, batch: str | None = None, batches: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one for each text that is new.

    It is the row with the largest id; of repeated rows with that id, one. Rows are matched
    by their own text's digest, so an id that also stands at another text does no harm.
    """
    digests, decided = _decided(docs, id_col, text_col, table, batch, batches)
    total = digests.count()
    stays = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))
    # whether repeated rows would stay shows in ids and digests alone
    again = repeated(join_groups(digests, decided.where("group_size > 1"), "digest", "group_size", total).where(stays).select("digest"), "digest")
    discard(digests)
    key = free(docs.columns, "_digest")
    names = {c: free(docs.columns, f"_{c}") for c in ("keep_id", "group_size", "fresh")}
    texts = decided.select(F.col("digest").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    rows = docs.withColumn(key, digest(named([text_col])[0]))
    met = join_groups(rows, texts, key, names["group_size"], total)
    own = met.where(F.col(names["fresh"]) & named([id_col])[0].cast("long").eqNullSafe(F.col(names["keep_id"]))).drop(*names.values())
    if again is None:
        return own.select(*named(docs.columns))
    return one_each(written(own, "survivors"), key, again.select(F.col("digest").alias(key))).select(*named(docs.columns))
