"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: At most this many keys count as hot, so the table of hot keys has a proven size (about 2 MB).
MAX_HOT_KEYS = 20_000
#: No key with fewer rows than this is hot.
MIN_HOT_ROWS = 64


#: Bytes of text that are worked on side by side; a longer text stands alone.
BLOCK = 6_000_000


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text stands alone."""
    at, n = 0, 0
    for i, k in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if n and n + k > size:
            yield at, i
            at, n = i, 0
        n += k
    if at < len(texts):
        yield at, len(texts)


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls and each row's offsets in them."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; empty rows give 0."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Memory that this process's allocators hold and don't use goes back to the system: idle workers count toward an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def appended(docs: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: list[tuple[str, str]]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fields`` (name, type), which the function from ``make()`` computes from blocks of whole texts.

    ``make`` is called once in each task. Only ``keep`` and the text reach Python, in blocks of bounded size.
    """
    twice = text not in keep
    own = docs.select(*named([*keep, text] if twice else keep))
    schema = T.StructType([*docs.select(*named(keep)).schema.fields, *[T.StructField(n, T.StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in fields]])
    n, at_text, names = len(keep), len(keep) if twice else keep.index(text), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        for b in batches:
            texts = b.column(at_text)
            for at, end in blocks(texts):
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *found(part.column(at_text))], names)
        del found
        give_back()

    return own.mapInArrow(run, schema)


def repeated(rows: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` that several of ``rows`` have, written; none if there are no such values, as is usual."""
    again = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    if again.isEmpty():
        discard(again)
        return None
    return again


def one_each(rows: DataFrame, key: str, again: DataFrame) -> DataFrame:
    """``rows`` (a written table) with one row for each value of ``key``: of several, which ``again`` names, the first by a hash of their values.

    They meet by an aggregate that is partial first; the other rows don't move.
    """
    fine = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    best = F.min_by(F.struct(*named(rows.columns)), F.xxhash64(*named(fine))).alias("_row")
    one = rows.join(again, key, "left_semi").groupBy(key).agg(best).select("_row.*")
    return rows.join(again, key, "left_anti").unionByName(one.select(*named(rows.columns)))


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(base)
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing will read again; any other table is left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null.

    For a text of ASCII alone ``lower`` does the same and is far cheaper than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join ``rows`` to ``groups`` (one row for each value of ``key``) without a hot task.

    ``size`` counts the rows of a group and ``total`` all rows. Groups above
    ``max(MIN_HOT_ROWS, total / MAX_HOT_KEYS)`` rows number at most ``MAX_HOT_KEYS``, so they
    are broadcast; rows of the others meet by a shuffle on the key, and rows that are done
    spread by their place in the input instead of meeting in one task, whatever they hold.
    """
    hot_rows = max(MIN_HOT_ROWS, total // MAX_HOT_KEYS)
    names = [c for c in groups.columns if c != key]
    hk, hv, rk, rs, rv, place, salt = (free(rows.columns, f"_{n}") for n in ("hot_key", "hot", "rest_key", "rest_salt", "rest", "place", "salt"))
    hot = groups.where(F.col(size) > hot_rows).select(F.col(key).alias(hk), F.struct(*names).alias(hv))
    # the rest's salt is always 0, but no literal: the optimizer would drop a literal from the shuffle's key
    rest = groups.where(F.col(size) <= hot_rows).select(
        F.col(key).alias(rk), F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias(rs), F.struct(*names).alias(rv)
    )
    marked = rows.withColumn(place, F.monotonically_increasing_id())
    marked = marked.join(F.broadcast(hot), F.col(key) == F.col(hk), "left").withColumn(
        salt, F.when(F.col(hk).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(place), F.lit(1 << 20)).cast("int"))
    )
    met = marked.join(rest, (F.col(key) == F.col(rk)) & (F.col(salt) == F.col(rs)), "left")
    return met.select(*named(rows.columns), *[F.coalesce(F.col(f"{hv}.{n}"), F.col(f"{rv}.{n}")).alias(n) for n in names])


def id_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
