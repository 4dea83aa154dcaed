"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language, nearest, packing, phrases, pii, repair, secrets, simhash, substring_dedup, toxicity
from .common import documents, id_fold

TOKENIZER = "word_bpe_49k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two batches, so that the second meets a filled index
    out = exact_dedup.dedup(documents(spark, sf_dir), batches=2)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(id_fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return bpe.encode_digests(documents(spark, sf_dir), path, ["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.select("doc_id", "text", "lang").where(id_fold(F.col("doc_id"), 3) != 1))
    found = language.predict(docs, model, ["doc_id"])
    return found.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_toxicity, op3_chat_format, op4_secrets, op5_bpe, op6_substring_dedup, op7_language, op8_simhash, op9_nearest, op10_packing,
        op11_phrases, op12_pii, op13_repair,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, row_number() OVER w AS k,
         list({'r': role, 'x': text}) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix,
         lead(turn) OVER w IS NULL AND row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), whole AS (
  SELECT min(conv_id) AS conv_id, CAST(k AS BIGINT) AS n_turns, count(*) AS n_copies, prefix FROM t WHERE last GROUP BY k, prefix
), proper AS (SELECT DISTINCT prefix FROM t WHERE NOT last)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(prefix, lambda p: '<|' || coalesce(p.r, '') || '|>' || chr(10) || coalesce(p.x, '') || chr(10)), '') AS rendered
FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper)
"""


_OP11 = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM t
), m AS (SELECT lang, w, count(*) AS m FROM p WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT lang, CAST(sum(m * len(w)) AS BIGINT) AS n FROM m GROUP BY lang),
g AS (
  SELECT lang, m, unnest(flatten(list_transform(range(1, 5), lambda k:
    list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM m
), f AS (SELECT lang, phrase, sum(m)::HUGEINT AS f FROM g GROUP BY ALL HAVING sum(m) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda k:
    list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM c WHERE len(w) > 2
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""

_OP13 = r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::UBIGINT) AS bytes
  FROM conversations
), d AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda a, x:
    list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z:
      CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END))) % 20 AS kind
  FROM b
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         regexp_replace(text, '[ 	-
]+$', '') AS body
  FROM e
), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM o), f AS (
  SELECT *, left(role, 1) AS i, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair
  FROM s
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM f GROUP BY conv_id
), scan AS (
  SELECT conv_id, 0::BIGINT AS k, {'c': 0, 'a': ''} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR) AS s1, {'c': 2, 'a': 'I'} AS s2, {'c': 4, 'a': 'II'} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, k, t0, t1,
         list_min([t2, {'c': t0.c + 2, 'a': t0.a || 'I'}, CASE WHEN t1 IS NOT NULL THEN {'c': t1.c + 2, 'a': t1.a || 'I'} END, {'c': t3.c + 2, 'a': t3.a || 'I'}]),
         list_min([t3, {'c': t2.c + 2, 'a': t2.a || 'I'}, {'c': t0.c + 4, 'a': t0.a || 'II'}, CASE WHEN t1 IS NOT NULL THEN {'c': t1.c + 4, 'a': t1.a || 'II'} END])
  FROM (
    SELECT r.conv_id, f.k, {'c': s0.c + 3, 'a': s0.a || 'D'} AS t0,
           list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 3, 'a': s1.a || 'D'} END, CASE WHEN stay AND f.i = 's' THEN {'c': s0.c + more, 'a': s0.a || 'K'} END]) AS t1,
           list_min(list_concat([{'c': s2.c + 3, 'a': s2.a || 'D'}], list_transform(list_filter([s0, s1, s3], lambda x: stay AND x IS NOT NULL),
             lambda x: {'c': x.c + more + CASE WHEN f.i = 'u' THEN 0 ELSE 2 END, 'a': x.a || CASE WHEN f.i = 'u' THEN 'K' ELSE 'R' END}))) AS t2,
           list_min([{'c': s3.c + 3, 'a': s3.a || 'D'},
             CASE WHEN stay THEN {'c': s2.c + more + CASE WHEN f.i = 'a' THEN 0 ELSE 2 END, 'a': s2.a || CASE WHEN f.i = 'a' THEN 'K' ELSE 'R' END} END]) AS t3
    FROM scan r JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stay, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more FROM f) f
      ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1
  )
), best AS (
  SELECT s.conv_id, list_min([s0, s3]) AS e FROM scan s JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.k = c.n_rows
), edits AS (
  SELECT conv_id, p, e.a[p] AS x, sum(CASE WHEN e.a[p] <> 'I' THEN 1 ELSE 0 END) OVER w AS k, sum(CASE WHEN e.a[p] <> 'D' THEN 1 ELSE 0 END) OVER w AS q
  FROM (SELECT conv_id, e, unnest(range(1, length(e.a) + 1)) AS p FROM best) WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), said AS (
  SELECT d.conv_id, p, x, q, f.role, f.text, max(CASE WHEN q = 1 AND x = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS sys
  FROM edits d LEFT JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND d.k = f.k AND x <> 'I' WHERE x <> 'D'
), done AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired
  FROM said GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN done d ON a.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    return {"op1_exact_dedup": _OP1, "op3_chat_format": _OP3, "op11_phrases": _OP11, "op13_repair": _OP13}
