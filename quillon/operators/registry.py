"""Named metrics and retrieval backends that callers plug together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import vectors as V
from . import folds
from . import ranking as R
from .blocks import top_rows


@dataclass(frozen=True)
class Metric:
    """``column`` makes the value from a table's columns; none stands for a metric that isn't available yet."""

    name: str
    category: str
    column: Callable[[DataFrame], Column] | None
    note: str = ""


class Metrics:
    """Metrics by name. One that isn't available, or can't be made for a table, gives null and doesn't stop the others."""

    def __init__(self, *metrics: Metric):
        self.metrics: dict[str, Metric] = {}
        for m in metrics:
            self.register(m)

    def register(self, metric: Metric) -> None:
        if metric.name in self.metrics:
            raise ValueError(f"metric already registered: {metric.name}")
        self.metrics[metric.name] = metric

    def evaluate(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """keys, metric, category, value (double), available, error: a row for each row and metric, by one pass over ``rows``."""
        made = []
        for m in self.metrics.values():
            value, error = F.lit(None), None
            if m.column is not None:
                try:
                    value = m.column(rows).try_cast("double")
                    rows.select(value)  # a column that the table can't have shows here
                except (AnalysisException, ValueError, TypeError, KeyError, AttributeError) as e:
                    value, error = F.lit(None), type(e).__name__
            available = m.column is not None and error is None
            made.append(F.struct(F.lit(m.name).alias("metric"), F.lit(m.category).alias("category"), value.cast("double").alias("value"), F.lit(available).alias("available"), F.lit(error).cast("string").alias("error")))
        return rows.select(*keys, F.explode(F.array(*made)).alias("_m")).select(*keys, "_m.*")


def _embed(queries: DataFrame, index: DataFrame) -> DataFrame:
    return R.cosine_pairs(queries, index.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("vec_id", "doc_id")


def _weighted(queries: DataFrame, index: DataFrame) -> DataFrame:
    return R.weighted_pairs(index, queries, *WEIGHTS)


def _dense(queries: DataFrame, index: DataFrame, parents: int = 3) -> DataFrame:
    """Groups of the index by their mean vectors first, then the rows of the best groups alone."""
    pooled = index.select("group", F.posexplode("vec").alias("i", "x")).groupBy("group", "i").agg(F.avg("x").alias("m"))
    pooled = pooled.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vec"))
    scored = R.cosine_pairs(queries, pooled.select(F.col("group").alias("vec_id"), "vec"))
    gate = R.top_k(scored, ["query_id"], parents, F.desc("score"), F.col("vec_id")).select("query_id", F.col("vec_id").alias("group"))
    rows = index.select("group", F.col("doc_id").alias("vec_id"), "vec")
    return R.gated_cosines(queries, rows, gate, ["group"]).select("query_id", F.col("vec_id").alias("doc_id"), "score")


def _siglip(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Of every ``FRAMES`` rows, which are one second, the best frame alone."""
    best = F.max(F.struct("score", (-F.col("doc_id")).alias("_d"))).alias("_b")
    scored = _embed(queries, index).withColumn("score", F.round("score", 6))
    return scored.groupBy("query_id", F.expr(f"doc_id div {FRAMES}")).agg(best).select("query_id", (-F.col("_b._d")).alias("doc_id"), "_b.score")


def _hierarchical(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Rows of the best groups, ``k`` of them that are ``APART`` from each other by their ids, filled up with the next best."""
    scored = _dense(queries, index).withColumn("score", F.round("score", 6))
    return folds.walked(scored, ["query_id"], [F.desc("score"), "doc_id"], ["doc_id"], lambda: folds.Apart(APART, k), fill=k).drop("pick")


#: Frames of a second, and places between rows that count as apart.
FRAMES, APART = 3, 4
#: Of cosine and BM25 in their weighted sum.
WEIGHTS = (0.7, 0.3)

#: Each backend takes queries (query_id, text, vec) and an index (doc_id, text, vec, group) and returns query_id, doc_id, score.
BACKENDS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "embed": _embed,
    "flat": lambda q, x: R.cosine_pairs(q, x.withColumnRenamed("doc_id", "vec_id"), V.dot).withColumnRenamed("vec_id", "doc_id"),
    "bm25": lambda q, x: R.bm25(x, q),
    "weighted": _weighted,
    "dense": _dense,
    "siglip": _siglip,
}
#: Backends that choose by what they have chosen before need to know how many rows are asked for.
CHOOSING: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"hierarchical": _hierarchical}


#: Backends by vectors alone keep their best rows in each task.
TOP_ROWS = {"embed": "cosine", "flat": "dot", "siglip": "cosine"}


def retrieve(queries: DataFrame, index: DataFrame, backend: str | Callable[[DataFrame, DataFrame], DataFrame] = "embed", k: int = 10) -> DataFrame:
    """query_id, doc_id, rank, score of the ``k`` >= 1 best rows of each query by a backend, by name or as a function; ties go to the smaller id."""
    if k < 1:
        raise ValueError("at least one row is to be found")
    if isinstance(backend, str) and backend not in BACKENDS | CHOOSING:
        raise ValueError(f"no such backend: {backend}")
    if backend == "bm25":
        return R.top_bm25(index, queries, k)
    if backend == "weighted":
        return R.top_weighted(index, queries, k, *WEIGHTS)
    if isinstance(backend, str) and backend in TOP_ROWS:
        # of every ``FRAMES`` rows, which are one second, the best frame alone
        return top_rows(queries, index, k, TOP_ROWS[backend], item="doc_id", per=FRAMES if backend == "siglip" else None)
    if isinstance(backend, str) and backend in CHOOSING:
        backend = partial(CHOOSING[backend], k=k)
    scored = (BACKENDS[backend] if isinstance(backend, str) else backend)(queries, index).withColumn("score", F.round("score", 6))
    return R.top_k(scored, ["query_id"], k, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "rank", "score")


def review_samples(df: DataFrame, key: str, quotas: list[tuple[str, Column, int]], seed: str) -> DataFrame:
    """key and bucket: of each (bucket, condition, quota) in order so many rows by a seeded hash, none twice.

    A row belongs to the buckets whose condition holds. Earlier quotas take first, so a later one passes over
    what they took; each quota's candidates are first cut to what all quotas before it could leave.
    """
    taken, out, before = None, None, 0
    order = R.hash_order(seed, key)
    for bucket, condition, n in quotas:
        pool = df.where(condition).select(key, order.alias("_h")).orderBy("_h", key).limit(n + before)
        if taken is not None:
            pool = pool.join(taken, key, "left_anti")
        own = pool.orderBy("_h", key).limit(n).select(key, F.lit(bucket).alias("bucket"))
        out = own if out is None else out.unionByName(own)
        taken = out.select(key)
        before += n
    return out


def greedy_stratified(cases: DataFrame, quotas: dict[str, int], key: str = "case_id", earlier: DataFrame | None = None, total: int | None = None, wide: tuple[str, ...] = ()) -> DataFrame:
    """case_id and pick (1, 2, ...) of cases that fill the quotas of types in their order, on top of an ``earlier`` selection.

    ``cases`` and ``earlier`` have case_id, type, hint, tags (array), video_id and width. What was selected earlier counts, and isn't picked again. Each
    pick takes, of the type's cases left, the one whose hint was taken least, with the most tags not yet taken, whose video was taken least, the
    widest (types in ``wide`` only; no width is 0) and then the smallest id. A type with too few cases is an error, and so is a selection that hasn't
    ``total`` cases in the end, with the earlier ones; picking stops at ``total``.

    Only counters join the picks, so cases that agree on type, hint, tags and video differ by width and id alone: the first n of each
    such group matter, and of each (type, hint, tags) the n + 1 videos that come first by earlier count, width and id, n being all quotas' sum.
    That bounded table is all that the driver picks from.
    """
    n, spark = sum(quotas.values()), cases.sparkSession
    width = F.when(F.col("type").isin(*wide), F.coalesce("width", F.lit(0.0)).cast("double")).otherwise(0.0)
    own = cases.where(F.col("type").isin(*quotas)).select(key, "type", "hint", F.array_join(F.array_sort("tags"), "\x1f").alias("tags"), "video_id", width.alias("width"))
    before = {"type": {}, "hint": {}, "tag": {}}
    own = own.withColumn("earlier", F.lit(0).cast("long"))
    chosen = 0
    if earlier is not None:
        counted = lambda column: {r[0]: r[1] for r in earlier.select(column.alias("x")).groupBy("x").count().collect()}  # noqa: E731  as many as there are types, hints and tags
        before = {"type": counted(F.col("type")), "hint": counted(F.col("hint")), "tag": counted(F.explode("tags"))}
        chosen = sum(before["type"].values())
        videos = earlier.groupBy("video_id").agg(F.count("*").alias("_n"))
        own = own.join(earlier.select(key), key, "left_anti").join(videos, "video_id", "left").withColumn("earlier", F.coalesce("_n", F.lit(0)))
    first = R.top_k(own, ["type", "hint", "tags", "video_id"], n, F.desc("width"), F.col(key)).withColumnRenamed("rank", "_r")
    heads = R.top_k(first.where("_r = 1"), ["type", "hint", "tags"], n + 1, F.col("earlier"), F.desc("width"), F.col(key)).select("type", "hint", "tags", "video_id")
    left: dict[str, dict] = {}
    for r in first.join(heads, ["type", "hint", "tags", "video_id"], "left_semi").collect():
        left.setdefault(r["type"], {})[r[key]] = (r, frozenset(filter(None, r["tags"].split("\x1f"))))
    types, hints, seen, taken, picks = Counter(before["type"]), Counter(before["hint"]), {t for t, k in before["tag"].items() if k}, Counter(), []
    for kind, quota in quotas.items():
        while types[kind] < quota and (total is None or chosen + len(picks) < total):
            pool = left.get(kind)
            if not pool:
                raise ValueError(f"too few cases of {kind!r}")
            place = lambda x: (hints[x[0]["hint"]], -len(x[1] - seen), x[0]["earlier"] + taken[x[0]["video_id"]], -x[0]["width"], x[0][key])
            best, tags = min(pool.values(), key=place)
            del pool[best[key]]
            picks.append((best[key], len(picks) + 1))
            types[kind] += 1
            hints[best["hint"]] += 1
            taken[best["video_id"]] += 1
            seen |= tags
    if total is not None and chosen + len(picks) != total:
        raise ValueError(f"{chosen + len(picks)} cases were selected, not {total}")
    return spark.createDataFrame(picks, f"{key} {cases.schema[key].dataType.simpleString()}, pick int")
