"""Stable identities, canonical hashes, manifests and journals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_id(prefix: str, *cols: str) -> Column:
    """prefix_ and twelve digits of the SHA-1 of the values, joined by bars; nulls are left out."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).cast("binary")), 1, 12))


def ordered_sha(col: str) -> Column:
    """SHA-256 of a group's values, one a line, in ascending order. The group's ids meet in one row."""
    lines = F.transform(F.array_sort(F.collect_list(col)), lambda x: x.cast("string"))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def tree_sha(df: DataFrame, key: str, order: str, content: str, fan: int = 1000, levels: int = 2) -> DataFrame:
    """key, sha: hashes of rows, then of blocks of ``fan`` of them by ``order``, level by level, then of a key's last blocks.

    No key's contents meet in one row: a row holds ``fan`` hashes at most, and the last one those of the blocks left.
    """
    x = df.select(key, F.col(order).alias("_o"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("_h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda r: r["_h"]), "").cast("binary"), 256).alias("_h")
    for _ in range(levels):
        x = x.groupBy(key, F.floor(F.col("_o") / fan).cast("long").alias("_b")).agg(joined).select(key, F.col("_b").alias("_o"), "_h")
    return x.groupBy(key).agg(joined).select(key, F.col("_h").alias("sha"))


def canonical_sha(*cols: str) -> Column:
    """SHA-256 of the compact JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))).cast("binary"), 256)


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256("\n".join(sorted(df.columns)).encode()).hexdigest()


def run_fingerprint(**parts: str) -> str:
    return hashlib.sha256("\n".join(f"{k}={parts[k]}" for k in sorted(parts)).encode()).hexdigest()


def table_fingerprint(df: DataFrame, order: str, content: Column, **parts: str) -> DataFrame:
    """rows, schema, content, run: how many rows a table has, the hash of its fields' names, that of ``content`` of all rows by a tree over ``order``, and of
    these and further parts of a run by name. Rows enter by their hash, so no text is held; an empty table has a null content."""
    rows = df.select(F.lit(0).alias("_t"), F.col(order).alias("_o"), content.alias("_c"))
    tree = tree_sha(rows, "_t", "_o", "_c").select(F.col("sha").alias("content"))
    total = df.agg(F.count("*").alias("rows"))
    made = total.join(tree, F.lit(True), "left").withColumn("schema", F.lit(schema_hash(df)))
    values = {"rows": F.col("rows").cast("string"), "schema": F.col("schema"), "content": F.coalesce("content", F.lit(""))} | {k: F.lit(v) for k, v in parts.items()}
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), values[k]) for k in sorted(values)])
    return made.select("rows", "schema", "content", F.sha2(lines.cast("binary"), 256).alias("run"))


def aggregate_manifest(files: DataFrame) -> DataFrame:
    """files, bytes, aggregate of a manifest (path, bytes, sha); its lines meet in one row."""
    line = F.concat_ws(" ", "path", F.col("bytes").cast("string"), "sha")
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("aggregate"))


def manifest_of(spark, path: str) -> DataFrame:
    """path, bytes, sha of every file below ``path``."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))


def verify(want: DataFrame, have: DataFrame) -> DataFrame:
    """path, state of the files of two manifests (path, bytes, sha) that differ: missing, unexpected or changed."""
    a, b = (x.select("path", F.struct("bytes", "sha").alias(n)) for x, n in ((want, "_a"), (have, "_b")))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def ledger(charges: DataFrame, account: str, charge: str, order: str, amount: str, budget: float) -> DataFrame:
    """account, charge, spent, within: each charge of an account once (the first by ``order``), the running sum, and whether the budget holds it."""
    once = charges.groupBy(account, charge).agg(F.min(F.struct(order, amount)).alias("_c"))
    w = Window.partitionBy(account).orderBy(f"_c.{order}", charge).rowsBetween(Window.unboundedPreceding, 0)
    x = once.withColumn("spent", F.sum(f"_c.{amount}").over(w))
    return x.select(account, charge, "spent", (F.col("spent") <= budget).alias("within"))


#: What may follow each state of an attempt; the empty state begins it.
TRANSITIONS = (
    ("", "pending"), ("pending", "sent"), ("sent", "response_saved"), ("response_saved", "validated"), ("validated", "checkpointed"),
    ("pending", "technical_failure"), ("sent", "technical_failure"), ("response_saved", "technical_failure"),
)


def journal_replay(journal: DataFrame, keys: list[str], order: list[str], state: str = "state") -> DataFrame:
    """keys, last_state, n_events, n_illegal, unfinished of each attempt in an append-only journal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    legal = F.lit(False)
    for a, b in TRANSITIONS:
        legal = legal | ((F.coalesce(F.col("_before"), F.lit("")) == a) & (F.col(state) == b))
    x = journal.withColumn("_before", F.lag(state).over(w)).withColumn("_bad", (~legal).cast("long"))
    return x.groupBy(*keys).agg(
        F.max_by(state, F.struct(*order)).alias("last_state"), F.count("*").alias("n_events"), F.sum("_bad").alias("n_illegal"),
    ).withColumn("unfinished", ~F.col("last_state").isin("checkpointed", "technical_failure"))
