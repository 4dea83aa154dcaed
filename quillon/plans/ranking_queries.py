"""Queries that rank, select and allocate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import folds
from ..operators import lexical as X
from ..operators import mediums as M
from ..operators import ranking as R
from ..operators.series import min_max
from ..sources.files import written
from .fixtures import IV, intervals, table
from .registry import query

TOK = "regexp_extract_all(lower(coalesce(text, '')), '([一-鿿]|[a-z0-9]+)')"


def _bm25_sql(tok: str) -> str:
    return f"""d AS (SELECT doc_id, {tok} AS w FROM documents), l AS (SELECT doc_id, w, len(w) AS dl FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), q AS (SELECT DISTINCT item_id AS query_id, unnest({tok}) AS t FROM benchmark),
p AS (SELECT t, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS t FROM l) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL)"""


BM = _bm25_sql(TOK)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM}, r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM bm) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM r QUALIFY rank <= 10")
def topk_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.top_bm25(table(spark, d, "documents"), _items(spark, d), 10)


@query("WITH " + _bm25_sql(r"regexp_extract_all(lower(coalesce(text, '')), '([\\u4e0-\\9f]|[a-z0-9]+)')") + ", r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM bm) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM r QUALIFY rank <= 10")
def topk_bm25_compat(spark: SparkSession, d: str) -> DataFrame:
    """With the over-escaped tokenizer."""
    return R.top_bm25(table(spark, d, "documents"), _items(spark, d), 10, T.tokens_compat)


QV = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), cs AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(v, q), 6) AS score FROM q, x)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "vec")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), e


def _gated(spark: SparkSession, d: str, gate: DataFrame) -> DataFrame:
    """Cosines of the vectors of the mediums that the gate (query_id, medium) lets through, and of no others."""
    q, e = _vectors(spark, d)
    return R.gated_cosines(q, e.withColumn("medium", F.expr("vec_id div 10")), gate, ["medium"]).withColumn("score", F.round("score", 6))


@query(f"WITH {QV} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, score FROM cs QUALIFY rank <= 10")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return B.top_rows(*_vectors(spark, d), 10)


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), x AS (SELECT vec_id, v, CASE WHEN n = 0 THEN 1 ELSE n END AS n FROM n),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_dot_product(x.v, q.v) / (x.n * q.n), 6) AS score FROM x, x q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 25""")
def topk_flat(spark: SparkSession, d: str) -> DataFrame:
    """Stored norms, zero ones as one; k of at least one and at most all rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return B.top_rows(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 25, "flat").select("query_id", "vec_id", "score")


@query(f"""WITH {BM}, {QV.replace('vec_id % 50 = 0', 'vec_id IN (SELECT item_id FROM benchmark)').replace('q AS (', 'qv AS (').replace('FROM q, x', 'FROM qv, x')}, a AS (SELECT query_id, vec_id AS doc_id, score FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20),
b AS (SELECT query_id, doc_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 20),
an AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS xa FROM a WINDOW w AS (PARTITION BY query_id)),
bn AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS xb FROM b WINDOW w AS (PARTITION BY query_id)),
fz AS (SELECT query_id, doc_id, round(0.7 * coalesce(xa, 0) + 0.3 * coalesce(xb, 0), 5) AS score FROM an FULL JOIN bn USING (query_id, doc_id))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM fz QUALIFY rank <= 10""")
def topk_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Every item asks by its text and by the vector of its own number."""
    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "vec")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")).distinct()
    a = B.top_rows(e.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "vec"), e, 20)
    a = a.select("query_id", F.col("vec_id").alias("doc_id"), "score")
    b = R.top_bm25(table(spark, d, "documents"), _items(spark, d), 20)
    f = R.fused(a, b, 0.7, 0.3).withColumn("score", F.round("score", 5))
    return R.top_k(f, ["query_id"], 10, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "rank", "score")


@query(f"WITH {QV}, b AS (SELECT query_id, vec_id // 3 AS sec, max(score) AS score FROM cs GROUP BY ALL) SELECT query_id, sec || '_' || (sec + 1) AS doc_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sec) <= 8")
def topk_siglip_second(spark: SparkSession, d: str) -> DataFrame:
    """The best frame of each second, then the best seconds; with max per bucket."""
    q, e = _vectors(spark, d)
    t = B.top_buckets(q, e.select(F.expr("vec_id div 3").alias("bucket"), F.lit(0).alias("tag"), "vec"), 8)
    sec = F.col("bucket")
    return t.select("query_id", F.concat_ws("_", sec.cast("string"), (sec + 1).cast("string")).alias("doc_id"), "score")


STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
STEM = "CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, -3) WHEN w LIKE '%ied' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, -1) ELSE w END"


def _stems_sql(col: str) -> str:
    return f"list_distinct(list_transform(list_filter({TOK.replace('text', col)}, lambda w: NOT list_contains({STOP}, w)), lambda w: {STEM}))"


LEX = f"q AS (SELECT item_id AS query_id, {_stems_sql('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_stems_sql('text')} AS w FROM documents), lx AS (SELECT query_id, doc_id, round(len(list_intersect(q, w)) / greatest(1, len(q)), 6) AS lexical FROM q, d)"


def _stemmed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The texts and the queries with their stems."""
    docs = R.balanced(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.stems(F.col("text")).alias("w"))
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.stems(F.col("text")).alias("w"))


def _by_stems(spark: SparkSession, d: str, work, schema: str) -> DataFrame | None:
    """Queries and texts by the stems that they share, counted inside tasks; none if the queries have too many stems for that."""
    return B.over_terms(*_stemmed(spark, d), work, schema)


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    """Shared stems over the query's stems, by an inverted join of stems: no pair without a shared stem arises."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.stems(F.col("text")).alias("q"))
    w = R.balanced(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.stems(F.col("text"))).alias("s"))
    met = q.select("query_id", F.size("q").alias("n"), F.explode("q").alias("s")).join(w, "s")
    return met.groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("k")).select("query_id", "doc_id", F.round(F.col("k") / F.greatest(F.lit(1), F.col("n")), 6).alias("lexical"))


@query(f"WITH {LEX} SELECT query_id, doc_id, lexical FROM lx")
def lexical_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of every query and every text, however little they share."""
    return B.over_every_term(*_stemmed(spark, d), X.every, X.PAIR)


@query(f"WITH {LEX} SELECT query_id, doc_id, lexical FROM lx WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 8")
def lexical_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = _by_stems(spark, d, X.nearest(8), X.PAIR)
    return R.top_k(_lexical(spark, d).where("lexical > 0") if found is None else found, ["query_id"], 8, F.desc("lexical"), F.col("doc_id")).drop("rank")


@query(f"WITH {LEX}, u AS (SELECT query_id % 4 AS unit, doc_id, lexical, query_id FROM lx WHERE lexical > 0) SELECT unit, doc_id, max(lexical) AS lexical, arg_max(query_id, (lexical, -query_id)) AS best_query, array_to_string(list_sort(list(DISTINCT query_id)), ',') AS queries FROM u GROUP BY unit, doc_id HAVING max(lexical) > 0.4")
def audio_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best variant of each search unit per transcript; with aggregate_max_over_units."""
    found = _by_stems(spark, d, X.units(4, 0.4), X.UNIT)
    if found is not None:
        return found
    u = _lexical(spark, d).withColumn("unit", F.col("query_id") % 4)
    g = u.groupBy("unit", "doc_id").agg(F.max("lexical").alias("lexical"), F.max_by("query_id", F.struct("lexical", -F.col("query_id"))).alias("best_query"), F.array_join(F.transform(F.array_sort(F.collect_set("query_id")), lambda x: x.cast("string")), ",").alias("queries"))
    return g.where("lexical > 0.4")


def _mediums(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The queries, and the vectors with their medium (ten vectors each) as bucket and the medium's parent, its first vector's label, as tag."""
    q, e = _vectors(spark, d)
    e = e.withColumn("bucket", F.expr("vec_id div 10"))
    parent = e.groupBy(F.col("bucket").alias("_b")).agg(F.min_by("label", "vec_id").alias("tag"))
    # several passes read them, and the size of a written table is known
    return q, written(e.join(parent, F.col("bucket").eqNullSafe(F.col("_b"))).select("bucket", "tag", "vec"), "mediums")


def _ranged(q: DataFrame, m: DataFrame) -> DataFrame:
    """The queries with the least and the most similarity of any medium, which the scale needs."""
    return q.join(B.bucket_range(q, m), "query_id", "left")


def _top_mediums(spark: SparkSession, d: str, k: int, scored=M.scored, each: bool = False) -> DataFrame:
    """query_id, medium, coarse (the parent), score, rank of the best mediums."""
    q, m = _mediums(spark, d)
    return B.top_buckets(_ranged(q, m), m, k, scored, each).withColumnsRenamed({"bucket": "medium", "tag": "coarse"})


MED = f"""{QV}, md0 AS (SELECT query_id, vec_id // 10 AS medium, max(score) AS sim, arg_min(label, vec_id) AS coarse, ((vec_id // 10 * 7 + query_id) % 11) / 10 AS lexical FROM cs GROUP BY ALL),
md AS (SELECT *, round(0.6 * (CASE WHEN max(sim) OVER w - min(sim) OVER w <= 1e-12 THEN 1.0 ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) END) + 0.3 * lexical, 6) AS score FROM md0 WINDOW w AS (PARTITION BY query_id))"""


@query(f"WITH {MED} SELECT query_id, medium, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, medium)::INTEGER AS rank FROM md")
def rank_all_mediums(spark: SparkSession, d: str) -> DataFrame:
    q, m = _mediums(spark, d)
    every = B.bucket_scores(_ranged(q, m), m, M.scored).withColumnRenamed("bucket", "medium")
    return R.top_k(every, ["query_id"], 1 << 30, F.desc("score"), F.col("medium")).select("query_id", "medium", "score", "rank")


@query(f"WITH {MED} SELECT query_id, medium, coarse, score FROM md WHERE coarse IN (2, 4, 6) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, medium) <= 6")
def medium_rank(spark: SparkSession, d: str) -> DataFrame:
    """Behind a coarse gate."""
    return _top_mediums(spark, d, 6, M.behind_a_gate).select("query_id", "medium", "coarse", "score")


@query(f"""WITH {MED}, c AS (SELECT query_id, coarse, round(avg(lexical) + CASE WHEN coarse % 3 = query_id // 50 % 3 THEN 0.25 ELSE 0 END, 6) AS score, coarse % 3 = query_id // 50 % 3 AS direct FROM md GROUP BY query_id, coarse)
SELECT query_id, coarse, score, direct, row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, score DESC, coarse DESC)::INTEGER AS rank FROM c QUALIFY rank <= 4""")
def coarse_route(spark: SparkSession, d: str) -> DataFrame:
    """Directly named parents first, ties to the larger id."""
    direct = F.col("coarse") % 3 == F.expr("query_id div 50") % 3
    q, e = _vectors(spark, d)
    m = e.groupBy(F.expr("vec_id div 10").alias("medium")).agg(F.min_by("label", "vec_id").alias("coarse"))
    # the lexical part goes by the medium's and the query's number modulo 11
    m = m.groupBy("coarse", (F.col("medium") % 11).alias("medium")).count()
    lex = ((F.col("medium") * 7 + F.col("query_id")) % 11) / 10
    c = m.crossJoin(q.select("query_id").distinct()).groupBy("query_id", "coarse").agg((F.sum(lex * F.col("count")) / F.sum("count")).alias("a")).withColumn("direct", direct)
    c = c.withColumn("score", F.round(F.col("a") + F.when(F.col("direct"), 0.25).otherwise(0.0), 6))
    return R.top_k(c, ["query_id"], 4, F.desc("direct"), F.desc("score"), F.desc("coarse")).select("query_id", "coarse", "score", "direct", "rank")


@query(f"WITH {MED}, g AS (SELECT query_id, medium, score FROM md QUALIFY row_number() OVER (PARTITION BY query_id, coarse ORDER BY score DESC, medium) = 1) SELECT query_id, medium FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, medium) <= 10")
def select_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The global strategy: the best of each parent, ten at most."""
    return _top_mediums(spark, d, 10, each=True).select("query_id", "medium")


@query(f"""WITH {MED}, gate AS (SELECT query_id, medium FROM md QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, medium) <= 5),
f AS (SELECT c.query_id, c.vec_id, c.vec_id // 10 AS medium, c.score AS raw FROM cs c JOIN gate g ON g.query_id = c.query_id AND g.medium = c.vec_id // 10)
SELECT query_id, medium, vec_id, raw, round(CASE WHEN max(raw) OVER w - min(raw) OVER w <= 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END, 5) AS scaled, row_number() OVER (PARTITION BY query_id, medium ORDER BY raw DESC, vec_id)::INTEGER AS rank_within FROM f WINDOW w AS (PARTITION BY query_id, medium)""")
def rerank_fine(spark: SparkSession, d: str) -> DataFrame:
    """The gate is a small semi-join before the fine vectors are ranked."""
    gate = _top_mediums(spark, d, 5).select("query_id", "medium")
    f = _gated(spark, d, gate).withColumnRenamed("score", "raw")
    w = Window.partitionBy("query_id", "medium").orderBy(F.desc("raw"), "vec_id")
    return f.select("query_id", "medium", "vec_id", "raw", F.round(min_max("raw", ["query_id", "medium"]), 5).alias("scaled"), F.row_number().over(w).alias("rank_within"))


@query(f"""WITH {MED}, c AS (SELECT query_id, coarse FROM md GROUP BY query_id, coarse QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(sim) DESC, coarse) <= 3),
m AS (SELECT md.query_id, medium FROM md JOIN c USING (query_id, coarse) QUALIFY row_number() OVER (PARTITION BY md.query_id ORDER BY sim DESC, medium) <= 6),
s AS (SELECT c.query_id, vec_id // 5 AS segment, max(c.score) AS best FROM cs c JOIN m ON m.query_id = c.query_id AND m.medium = c.vec_id // 10 GROUP BY ALL)
SELECT query_id, segment, best FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, segment) <= 6""")
def dense_beam_b(spark: SparkSession, d: str) -> DataFrame:
    """Parents, then mediums under them, then segments by their best frame, six of each at most."""
    q, m = _mediums(spark, d)
    c = B.top_buckets(q, m, 3, item="tag").groupBy("query_id")
    c = c.agg(*[F.coalesce(F.max(F.when(F.col("rank") == r, F.col("tag"))), F.lit(int(B.NONE) + 1)).alias(f"p{r}") for r in (1, 2, 3)])
    m = B.top_buckets(q.join(c, "query_id", "left"), m, 6, M.under_parents).select("query_id", F.col("bucket").alias("medium"))
    f = _gated(spark, d, m)
    s = f.groupBy("query_id", F.expr("vec_id div 5").alias("segment")).agg(F.max("score").alias("best"))
    return R.top_k(s, ["query_id"], 6, F.desc("best"), F.col("segment")).drop("rank")


@query(f"""WITH RECURSIVE {MED}, gate AS (SELECT query_id, medium FROM md QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, medium) <= 8),
f AS (SELECT c.query_id, c.vec_id, c.score, row_number() OVER (PARTITION BY c.query_id ORDER BY c.score DESC, c.vec_id) AS i FROM cs c JOIN gate g ON g.query_id = c.query_id AND g.medium = c.vec_id // 10),
g AS (SELECT query_id, i, [vec_id] AS taken FROM f WHERE i = 1 UNION ALL SELECT f.query_id, f.i, CASE WHEN len(taken) < 6 AND len(list_filter(taken, lambda y: abs(y - f.vec_id) < 4)) = 0 THEN list_append(taken, f.vec_id) ELSE taken END FROM g JOIN f ON f.query_id = g.query_id AND f.i = g.i + 1),
t AS (SELECT query_id, arg_max(taken, i) AS taken FROM g GROUP BY query_id), r AS (SELECT t.query_id, list(f.vec_id ORDER BY f.i) AS rest FROM t JOIN f ON f.query_id = t.query_id WHERE NOT list_contains(taken, f.vec_id) GROUP BY t.query_id)
SELECT t.query_id, unnest(list_concat(taken, list_slice(coalesce(rest, []), 1, greatest(0, 6 - len(taken))))) AS vec_id FROM t LEFT JOIN r USING (query_id)""")
def hierarchical_gated(spark: SparkSession, d: str) -> DataFrame:
    """Gate by mediums, rank fine rows, keep six that are apart, fill up."""
    gate = _top_mediums(spark, d, 8).select("query_id", "medium")
    f = _gated(spark, d, gate)
    return folds.walked(f, ["query_id"], [F.desc("score"), "vec_id"], ["vec_id"], lambda: folds.Apart(4, 6), fill=6).select("query_id", "vec_id")


# -- allocation -------------------------------------------------------------------


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), s AS (SELECT *, n * 100 / sum(n) OVER () AS share FROM n), b AS (SELECT *, floor(share + 1e-9)::BIGINT AS base, round(share - floor(share + 1e-9), 9) AS rest FROM s) SELECT p_brand, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, p_brand) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS seats FROM b")
def hamilton_allocation(spark: SparkSession, d: str) -> DataFrame:
    return R.hamilton(table(spark, d, "part"), "p_brand", 100)


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat('seed-7', chr(0), p_partkey)), p_partkey) <= 5")
def hash_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_sample(table(spark, d, "part"), "p_brand", "p_partkey", 5, "seed-7").select("p_brand", "p_partkey")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), g AS (SELECT count(DISTINCT p_brand) AS g FROM part) SELECT p_partkey, p_brand FROM r, g ORDER BY (r <= floor(60 / g)) DESC, p_retailprice DESC, p_partkey LIMIT 60")
def allocate_quota(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    g = p.agg(F.countDistinct("p_brand").alias("g"))
    return R.quota(p.crossJoin(F.broadcast(g)), "p_brand", 60, [F.desc("p_retailprice"), F.col("p_partkey")], F.col("g")).select("p_partkey", "p_brand")


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_partkey, p_brand, turn::INTEGER AS turn FROM r ORDER BY turn, p_brand LIMIT 70")
def balanced_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return R.round_robin(table(spark, d, "part"), "p_brand", [F.col("p_partkey")], 70).select("p_partkey", "p_brand", "turn")


_UNION = "list_sum(list_transform(range(1, len({x}) + 1), lambda k: greatest(0.0, {x}[k].e - greatest({x}[k].s, coalesce(list_max(list_transform({x}[1:k - 1], lambda y: y.e)), {x}[k].s)))))"


@query(f"""WITH RECURSIVE {IV}, p AS (SELECT video_id, id, modality, start_sec AS s, end_sec AS e, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, start_sec, id) AS i FROM iv),
g AS (SELECT video_id, i, [id] AS ids, [modality] AS mods, [{{'s': s, 'e': e}}] AS spans FROM p WHERE i = 1 UNION ALL
 SELECT video_id, i, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(mods, modality) ELSE mods END, CASE WHEN ok THEN more ELSE spans END
 FROM (SELECT *, len(list_filter(mods, lambda y: y = modality)) < CASE modality WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 5 END AND {_UNION.format(x='more')} <= 36000 AS ok
  FROM (SELECT p.*, g.ids, g.mods, g.spans, list_sort(list_append(g.spans, {{'s': p.s, 'e': p.e}})) AS more FROM g JOIN p ON p.video_id = g.video_id AND p.i = g.i + 1)))
SELECT video_id, unnest(arg_max(ids, i)) AS id FROM g GROUP BY video_id""")
def apply_budget(spark: SparkSession, d: str) -> DataFrame:
    """By priority over all candidates: at most two, three or five of a kind, and ten hours of their union; what overlaps counts once."""
    rule = lambda: folds.Budget(36000.0, {"view": 2, "click": 3}, 5)
    return folds.walked(intervals(spark, d), ["video_id"], [F.desc("value"), "start_sec", "id"], ["modality", "start_sec", "end_sec"], rule).select("video_id", "id")


@query(f"""WITH {IV}, r AS (SELECT *, modality IN ('purchase', 'signup') AS protected FROM iv), n AS (SELECT *, row_number() OVER (PARTITION BY video_id, protected ORDER BY value DESC, start_sec, id) AS k, count(*) FILTER (WHERE protected) OVER (PARTITION BY video_id) AS np FROM r)
SELECT video_id, id, protected FROM n WHERE protected OR (k <= 3 AND k + np <= 30)""")
def packet_budget(spark: SparkSession, d: str) -> DataFrame:
    """Protected roles always stay; supporting ones up to three, while the packet has room."""
    r = intervals(spark, d).withColumn("protected", F.col("modality").isin("purchase", "signup"))
    k = F.row_number().over(Window.partitionBy("video_id", "protected").orderBy(F.desc("value"), "start_sec", "id"))
    np = F.sum(F.col("protected").cast("int")).over(Window.partitionBy("video_id"))
    return r.withColumn("k", k).withColumn("np", np).where("protected or (k <= 3 and k + np <= 30)").select("video_id", "id", "protected")


@query(f"WITH {IV} SELECT id, CASE modality WHEN 'purchase' THEN 100 WHEN 'signup' THEN 80 WHEN 'click' THEN 50 WHEN 'view' THEN 30 ELSE 10 END + CASE WHEN value > 50 THEN 5 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS priority FROM iv")
def role_priority(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("modality") == "purchase", 100).when(F.col("modality") == "signup", 80).when(F.col("modality") == "click", 50).when(F.col("modality") == "view", 30).otherwise(10)
    return intervals(spark, d).select("id", (base + F.when(F.col("value") > 50, 5).otherwise(0) + F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("priority"))


@query(f"WITH {IV}, c AS (SELECT video_id, id, start_sec FROM iv QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(value) DESC, modality, id) <= 16) SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id)::INTEGER AS position FROM c")
def cap16(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen by relevance, response order and input index, then in the order of time."""
    c = R.top_k(intervals(spark, d).withColumn("r", F.round("value")), ["video_id"], 16, F.desc("r"), F.col("modality"), F.col("id"))
    return c.select("video_id", "id", F.row_number().over(Window.partitionBy("video_id").orderBy("start_sec", "id")).alias("position"))


@query(f"WITH {IV}, x AS (SELECT *, CASE WHEN id % 4 <> 0 THEN abs(start_sec - 1705000000.0) END AS anchor FROM iv) SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY anchor ASC NULLS LAST, value DESC, id)::INTEGER AS by_anchor, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, anchor ASC NULLS LAST, id)::INTEGER AS by_meaning FROM x")
def rank_visual_micro(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).withColumn("anchor", F.when(F.col("id") % 4 != 0, F.abs(F.col("start_sec") - 1705000000.0)))
    a, p = F.col("anchor").asc_nulls_last(), Window.partitionBy("video_id")
    return x.select("video_id", "id", F.row_number().over(p.orderBy(a, F.desc("value"), "id")).alias("by_anchor"), F.row_number().over(p.orderBy(F.desc("value"), a, "id")).alias("by_meaning"))
