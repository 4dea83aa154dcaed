"""File sources and sinks: JSON, JSON lines, CSV, subtitles, trees of files, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (base or tempfile.mkdtemp(prefix="quillon-")).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{work_dir(df.sparkSession)}/quillon/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file objects or arrays."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines go, what isn't an object lands in _corrupt, a missing path gives no rows."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        rows.schema  # noqa: B018
        return rows
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, _corrupt string")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tree(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON files by a glob, each row with its file's path and time of change."""
    rows = spark.read.schema(schema).json(glob)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key)
    return rows.withColumn("n_files", F.count("*").over(w)).where("n_files > 1")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest file per key; of equal times the larger path."""
    cols = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("file_time", "file_path")).alias("b"))
    return best.select(*keys, "b.*")


def srt_time(c: Column) -> Column:
    """Seconds of HH:MM:SS,mmm."""
    p = F.split(F.regexp_replace(F.trim(c), ",", "."), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def parse_srt(blocks: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """keys, start_sec, end_sec, text of subtitle blocks.

    Empty texts go; an end at or before its start becomes start + 1; blocks with the same
    key and times merge their texts in order.
    """
    time = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)"
    x = blocks.select(
        *keys, srt_time(F.regexp_extract(block, time, 1)).alias("start_sec"), srt_time(F.regexp_extract(block, time, 2)).alias("e"),
        F.trim(F.regexp_replace(F.regexp_extract(block, r"(?s)-->[^\n]*\n(.*)$", 1), r"\s+", " ")).alias("text"),
    ).where("text <> '' and start_sec is not null")
    x = x.withColumn("end_sec", F.when(F.col("e") <= F.col("start_sec"), F.col("start_sec") + 1).otherwise(F.col("e")))
    return x.groupBy(*keys, "start_sec", "end_sec").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("block"))
    return parse_srt(blocks, ["file_path"])


def parse_subtitles(rows: DataFrame, keys: list[str], longest: float = 5.0) -> DataFrame:
    """Segments with other names for their times; one without an end runs to the next start, ``longest`` seconds at most."""
    names = set(rows.columns)
    first = lambda *cs: F.coalesce(*[F.col(c).cast("double") for c in cs if c in names])
    x = rows.withColumn("start_sec", first("start", "start_time", "begin", "from")).withColumn("_e", first("end", "end_time", "stop", "to"))
    nxt = F.lead("start_sec").over(Window.partitionBy(*keys).orderBy("start_sec", "text"))
    end = F.when(F.col("_e") > F.col("start_sec"), F.col("_e")).otherwise(F.least(F.coalesce(nxt, F.col("start_sec") + longest), F.col("start_sec") + longest))
    return x.withColumn("end_sec", end).select(*keys, "start_sec", "end_sec", "text")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; newlines and tabs inside texts are escaped."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    out = df.select(*[F.regexp_replace(F.regexp_replace(c, "\n", r"\\n"), "\t", r"\\t").alias(c) if c in texts else F.col(c) for c in df.columns])
    out.write.option("header", True).option("sep", "\t").csv(path)


def write_checkpoint(df: DataFrame, path: str, by: str | None = None) -> None:
    """Refuses to overwrite; the committer renames whole files into place."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)


def union_of_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both under the union of their columns."""
    return a.unionByName(b, allowMissingColumns=True)


def valid_segments(rows: DataFrame) -> DataFrame:
    """Segments with a text that isn't blank and an end after their start."""
    return rows.where((F.trim("text") != "") & (F.col("end_sec") > F.col("start_sec")))


def resume(spark: SparkSession, cases: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work on the cases that ``path`` doesn't have yet, append their rows there and return all rows of the cases asked for."""
    try:
        done = spark.read.parquet(path)
        missing = cases.join(done.select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        missing = cases
    work(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(cases.select(key), key, "left_semi")
