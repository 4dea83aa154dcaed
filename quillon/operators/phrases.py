"""Phrases in texts: contained in one form or another, alike as a whole, or alike to a window.

The phrases are a stated set of queries, held against every text. They reach the tasks in blocks of at most ``BLOCK_BYTES``, as
broadcasts, each of which is gone through once; a set of any size takes several passes over the texts and never more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..sources.files import written

#: Bytes of the phrases in a block.
BLOCK_BYTES = 8 << 20

_KINDS = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def _blocks(phrases: DataFrame) -> Iterator[list]:
    """Rows (k, phrase) in blocks of about half of ``BLOCK_BYTES``, dealt by hash; one block at a time reaches the driver."""
    own = phrases.where("k is not null").select("k", F.coalesce("phrase", F.lit("")).alias("phrase"))
    total = own.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_BYTES))
    p = written(own.withColumn("block", F.pmod(F.xxhash64("k", "phrase"), F.lit(n))), "phrases")
    for block in range(n):
        if rows := p.where(F.col("block") == block).orderBy("k", "phrase").collect():
            yield rows


def _against(texts: DataFrame, phrases: DataFrame, make: Callable[[list[str]], Callable[[Iterable[str]], Iterable[tuple]]], found: str) -> DataFrame:
    """doc_id, k and the columns ``found`` (DDL) of what the function from ``make(phrases)`` gives for the texts of a batch: tuples that begin with a text's and a phrase's place."""
    kind = dict(texts.dtypes)["doc_id"], dict(phrases.dtypes)["k"]
    schema = f"doc_id {kind[0]}, k {kind[1]}, {found}"
    types = [pa.from_numpy_dtype("int64") if t == "long" else _KINDS.get(t) for t in (x.split()[1] for x in found.split(", "))]
    names = ["doc_id", "k", *[x.split()[0] for x in found.split(", ")]]
    spark = texts.sparkSession

    def one(block: list) -> DataFrame:
        ks, shared = [r.k for r in block], spark.sparkContext.broadcast([r.phrase for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = make(shared.value)
            for b in batches:
                ids = b["doc_id"].to_pylist()
                out = [(ids[n], ks[k], *hit) for n, k, *hit in search(t.as_py() or "" for t in b["text"])]
                columns = [pa.array([r[n] for r in out], t) for n, t in enumerate([b.schema.field("doc_id").type, None, *types])]
                columns[1] = columns[1].cast(k_type) if len(out) else pa.array([], k_type)
                yield pa.RecordBatch.from_arrays(columns, names)

        k_type = _KINDS[kind[1]]
        return texts.select("doc_id", "text").mapInArrow(run, schema)

    parts = [one(block) for block in _blocks(phrases)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _each(search: Callable[[str], Iterable[tuple]]) -> Callable[[Iterable[str]], Iterator[tuple]]:
    return lambda texts: ((n, *hit) for n, text in enumerate(texts) for hit in search(text))


def _contained(phrases: list[str]) -> Callable[[Iterable[str]], Iterator[tuple]]:
    a = fuzzy.Automaton(phrases)
    return _each(lambda text: [(k, *r) for k, r in a.search(text).items()])


def _laddered(phrases: list[str]) -> Callable[[Iterable[str]], Iterator[tuple]]:
    a = fuzzy.Automaton(phrases)
    last = fuzzy.Alike([f[-1] for f in a.forms])

    def search(texts: Iterable[str]) -> Iterator[tuple]:
        for some in _together(enumerate(map(fuzzy.forms, texts))):
            found = [a.standing(own) for _, own in some]
            yield from ((n, k, *r) for (n, _), hits in zip(some, found, strict=True) for k, r in hits.items())
            for at, k, ratio in last.search([own[-1] for _, own in some], found):
                yield some[at][0], k, fuzzy.FUZZY_RUNG, ratio

    return search


def _together(texts: Iterable[tuple[int, tuple[str, ...]]]) -> Iterator[list[tuple[int, tuple[str, ...]]]]:
    """Texts by their places and forms, as many as are held against the phrases at once."""
    some, size = [], 0
    for n, own in texts:
        some.append((n, own))
        size += len(own[-1])
        if len(some) >= fuzzy.TEXTS or size >= fuzzy.AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _windowed(phrases: list[str]) -> Callable[[Iterable[str]], Iterator[tuple]]:
    return fuzzy.Phrases(phrases).search


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, k, method, score of the phrases (k, phrase) that stand in a text (doc_id, text): as they are, but for case, or but for punctuation.

    One pass of an automaton over each text, whatever the number of phrases. Null texts and phrases count as empty; an empty phrase stands in
    every text, one of punctuation alone only as it is. Rows that repeat give their matches each; a null k takes no part.
    """
    return _against(texts, phrases, _contained, "method string, score double")


def laddered(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``contained``, and last the pairs whose letters have a sequence matcher's ratio of 0.6 or more."""
    return _against(texts, phrases, _laddered, "method string, score double")


def windowed(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, k, ratio of the best window of a text, of as many words as the phrase has, if it reaches 0.85 by the sequence matcher."""
    return _against(texts, phrases, _windowed, "ratio double")


def with_ambiguity(matches: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Adds n_matches and ambiguity_warning (null for a single match) of the matches with the same keys, and position, their place by score and ``order``.

    Counts are joined, not windowed over; a position needs its key's matches in order.
    """
    n = matches.groupBy(*keys).agg(F.count("*").alias("n_matches"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    out = matches.withColumn("position", F.row_number().over(w)).join(n, keys)
    return out.withColumn("ambiguity_warning", F.when(F.col("n_matches") > 1, "multiple_possible_matches"))
