"""A training-data pipeline: toxicity, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Every decision belongs to a row and its text, never to an id that other rows may share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, packing, secrets, simhash, toxicity
from quillon.llm.common import discard, documents, named, written


def _prefix(docs: DataFrame) -> str:
    """A beginning that no column has."""
    p = "_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the labels of all of them may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    p = _prefix(docs)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), docs.columns, prefix=p)
    return scored.where(F.col(f"{p}score") < 0.5).select(*named(docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the largest id. They reach the index in two batches."""
    return exact_dedup.survivors(docs, batches=2)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, a similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash.representatives(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows where a text changed. Every document stays."""
    p = _prefix(docs)
    found = secrets.scan(docs, docs.columns, redact=True, prefix=p)
    changed, text = F.col(f"{p}spans") != "", F.col(f"{p}redacted")
    new = {"n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars")), "text": F.when(changed, text).otherwise(F.col("text"))}
    return found.select(*[new[c].alias(c) if c in new else named([c])[0] for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name)
        discard(docs)  # the stage's input, if it was a table of an earlier stage
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
