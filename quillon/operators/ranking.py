"""Rankings: lexical, vector, fused, hierarchical; quotas and budgets. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.files import written
from . import blocks
from .blocks import balanced


#: Rows (query, term) that may be broadcast, about 50 MB.
BROADCAST_TERMS = 1_000_000
#: Queries (rows with a vector or a text) that may be broadcast.
BROADCAST_QUERIES = 20_000


def small(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, and it meets the other side block by block."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key with rank 1, 2, ...; partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with rank (1, 2, ...) and size of each key's rows, by columns ``order`` (ascending, the last ones unique).

    Rows are dealt by ranges of key and order; a task ranks its range and adds how many rows of the key came in the ranges before. So a key
    that holds most rows is spread over many tasks. The ranges are written, since all passes must see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = x.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(w)).drop("_n")
    own = x.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    same = [own[k].eqNullSafe(sizes[k]) for k in [*keys, "_p"]]
    met = own.join(sizes, same)
    return met.select(*[own[c] for c in df.columns], (F.col("_r") + F.col("_before")).alias("rank"), "size")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, tokenizer=T.tokens) -> DataFrame:
    """query_id, doc_id, score > 0. ``docs`` has doc_id and text, ``queries`` query_id and text.

    Texts are tokenised once: the postings of the queries' terms are written to the shared folder, with one of the
    empty term for each text, which no token is and which carries the number and lengths of all texts. Document
    frequencies and scores come from the postings. The queries' terms are broadcast up to ``BROADCAST_TERMS``;
    beyond that they meet the postings by a shuffled join.
    """
    d = balanced(docs.select("doc_id", "text")).select("doc_id", tokenizer(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("t"))
    few = F.broadcast if q.count() <= BROADCAST_TERMS else (lambda x: x)
    terms = q.select("t").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "t string"))
    found = d.select("doc_id", "dl", F.explode(F.concat(F.array(F.lit("")), "w")).alias("t")).join(few(terms), "t", "left_semi")
    posts = found.groupBy("doc_id", "dl", "t").agg(F.count("*").alias("tf"))
    posts = written(posts, "postings")
    total = posts.where("t = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    posts = posts.where("t <> ''")
    df = posts.groupBy("t").agg(F.count("*").alias("df"))
    asked = few(q.join(df, "t").groupBy("t", "df").agg(F.collect_list("query_id").alias("qs")))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = posts.join(asked, "t").crossJoin(F.broadcast(total)).select("doc_id", weight.alias("x"), F.explode("qs").alias("query_id"))
    return scored.groupBy("query_id", "doc_id").agg(F.sum("x").alias("score")).where("score > 0")


def top_bm25(docs: DataFrame, queries: DataFrame, k: int, tokenizer=T.tokens) -> DataFrame:
    """query_id, doc_id, rank, score of the ``k`` best texts of each query; as matrices, or by shuffled postings if the queries have too many terms for that."""
    found = blocks.top_bm25(balanced(docs.select("doc_id", "text")), queries, k, tokenizer)
    if found is None:
        scored = bm25(docs, queries, tokenizer=tokenizer).withColumn("score", F.round("score", 6))
        found = top_k(scored, ["query_id"], k, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "rank", "score")
    return found


def top_weighted(docs: DataFrame, queries: DataFrame, k: int, wa: float, wb: float, tokenizer=T.tokens) -> DataFrame:
    """query_id, doc_id, rank, score of the ``k`` best rows (doc_id, text, vec) of each query by ``fused`` cosine and BM25; as matrices, or by pairs where those can't be made."""
    found = blocks.top_weighted(balanced(docs.select("doc_id", "text", "vec")), queries, k, wa, wb, tokenizer)
    if found is None:
        found = top_k(weighted_pairs(docs, queries, wa, wb, tokenizer).withColumn("score", F.round("score", 6)), ["query_id"], k, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "rank", "score")
    return found


def weighted_pairs(docs: DataFrame, queries: DataFrame, wa: float, wb: float, tokenizer=T.tokens) -> DataFrame:
    """query_id, doc_id, score of every query and row."""
    cosines = cosine_pairs(queries, docs.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("vec_id", "doc_id")
    return fused(cosines, bm25(docs, queries, tokenizer=tokenizer), wa, wb)


def cosine_pairs(queries: DataFrame, rows: DataFrame, how=V.cosine) -> DataFrame:
    """query_id, vec_id, score of every query against all rows.

    The queries are the stated set; up to ``BROADCAST_QUERIES`` of them are broadcast, more meet the rows in blocks.
    """
    q = queries.select("query_id", F.col("vec").alias("_q"))
    return rows.select("vec_id", "vec").crossJoin(small(q)).select("query_id", "vec_id", how(F.col("vec"), F.col("_q")).alias("score"))


def gated_cosines(queries: DataFrame, rows: DataFrame, gate: DataFrame, keys: list[str], how=V.cosine) -> DataFrame:
    """query_id, keys, vec_id, score of the rows that a gate (query_id and keys) lets through: joined before anything is scored."""
    near = rows.join(gate, keys).join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
    return near.select("query_id", *keys, "vec_id", how(F.col("vec"), F.col("_q")).alias("score"))


def fused(a: DataFrame, b: DataFrame, wa: float, wb: float, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Weighted sum of two hit lists, each scaled to [0, 1] within its own list; a missing hit counts 0."""
    from .series import min_max

    x = a.select(key, item, min_max("score", [key]).alias("xa"))
    y = b.select(key, item, min_max("score", [key]).alias("xb"))
    return x.join(y, [key, item], "full").select(key, item, (wa * F.coalesce("xa", F.lit(0.0)) + wb * F.coalesce("xb", F.lit(0.0))).alias("score"))


def quota(df: DataFrame, group: str, total: int, order: list[Column], groups: Column) -> DataFrame:
    """``total`` rows: first total div groups of each group, then the best of the rest."""
    own = Window.partitionBy(group).orderBy(*order)
    x = df.withColumn("_r", F.row_number().over(own)).withColumn("_base", F.floor(F.lit(total) / groups)).withColumn("_in", F.col("_r") <= F.col("_base"))
    ranked = x.orderBy(F.desc("_in"), *order).limit(total)
    return ranked.drop("_r", "_base", "_in")


def hamilton(df: DataFrame, strata: str, total: int) -> DataFrame:
    """Seats of each stratum by largest remainder; ties go to the smaller stratum."""
    n = df.groupBy(strata).agg(F.count("*").alias("n"))
    share = F.col("n") * total / F.sum("n").over(Window.partitionBy())
    x = n.withColumn("base", F.floor(share + 1e-9).cast("long")).withColumn("rest", F.round(share - F.floor(share + 1e-9), 9))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), strata))
    return x.select(strata, "n", (F.col("base") + F.when(r <= left, 1).otherwise(0)).cast("long").alias("seats"))


def hash_order(seed: str, key: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)


def hash_sample(df: DataFrame, strata: str, key: str, k: int, seed: str) -> DataFrame:
    """The ``k`` rows of each stratum that come first by a seeded hash."""
    return top_k(df.withColumn("_h", hash_order(seed, key)), [strata], k, F.col("_h"), F.col(key)).drop("_h")


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One of each group in turn until ``n``."""
    x = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return x.orderBy("turn", group).limit(n)
