"""Phrase collocation mining: phrases whose words keep together, for each language.

1. Texts are split into pieces; identical pieces of a language become one row with a multiplicity.
2. Tasks count the weighted n-grams of blocks of pieces and deal them by a hash of language and phrase. Each
   hash bucket is summed by duckdb in one task, out of core: beyond its memory limit it spills to a folder of its own,
   which the task removes. Only phrases from the threshold on leave a bucket.
3. Words and pairs come first. A longer phrase is only as frequent as the pairs in it, so it is counted only
   where all its pairs may be frequent. The frequent pairs are known by a bit set of fixed size: a false hit
   costs a count, never a result.
4. A candidate asks for the counts of its parts: requests are dealt by the part and meet its count there; parts that
   very many candidates ask for are met by a broadcast of bounded size (``join_groups``).

Counts and scores are whole numbers; products are made in decimals of 38 digits.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, join_groups, written

#: Words of the longest phrase.
LONGEST = 4
#: A candidate occurs at least so often.
LEAST = 30
#: Rows reported for each language.
TOP = 2000
#: A candidate goes if a longer one that holds it has at least this share of its count, in hundredths.
INSIDE = 80
#: Bits of the set of frequent pairs (16 MB).
FILTER_BITS = 1 << 27
#: Characters of pieces that are counted side by side.
BLOCK = 12_000_000
#: Memory of duckdb in a task before it spills.
MEMORY = "250MB"

_SPLIT = r"[.,;:!?\x0A-\x0D]"
_COUNTS = "lang string, phrase string, f long"


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by one blank), m: how often that piece occurs in the language; null language: ``und``, null text: empty."""
    text = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _SPLIT)
    each = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(text).alias("piece"))
    tidy = F.trim(F.regexp_replace("piece", r"[ \t]+", " "))
    return each.select("lang", tidy.alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed weights, and each key's place among the distinct ones."""
    if not len(keys):
        return keys, weights, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    return s[first], np.add.reduceat(weights[order], first), place


class Block:
    """The words of pieces of one language, by number, and what follows from them."""

    def __init__(self, lang: str, found: pa.Array, m: np.ndarray):
        lists = pc.split_pattern(found.cast(pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        self.lang, self.words = lang, words.dictionary
        self.id = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.repeat(np.arange(len(found)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.m = m[self.piece]
        self.next = self.piece[1:] == self.piece[:-1]  # the pair at i stays in its piece

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs; first and second word of the distinct ones as one key; their counts; which is at each place."""
        at = np.flatnonzero(self.next)
        keys, f, which = _sums(self.id[at] * len(self.words) + self.id[at + 1], self.m[at])
        return at, keys, f, which

    def named(self, *columns: np.ndarray) -> pa.Array:
        taken = [self.words.take(pa.array(c)) for c in columns]
        return pc.binary_join_element_wise(*taken, pa.scalar(" ", taken[0].type)) if len(taken) > 1 else taken[0]

    def batch(self, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        lang = pa.repeat(pa.scalar(self.lang), len(f))
        return pa.RecordBatch.from_arrays([lang, phrases.cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"])

    def short(self) -> Iterator[pa.RecordBatch]:
        """Counts of words and pairs."""
        keys, f, _ = _sums(self.id, self.m)
        yield from sliced(self.batch, f, lambda a, b: self.named(keys[a:b]))
        _, keys, f, _ = self.pairs()
        n = max(1, len(self.words))
        yield from sliced(self.batch, f, lambda a, b: self.named(keys[a:b] // n, keys[a:b] % n))

    def long(self, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of phrases of 3 words and more whose pairs are all in the bit set."""
        at, keys, _, which = self.pairs()
        n = max(1, len(self.words))
        own = word_hashes(self.words)
        bit = pair_bits(own[keys // n], own[keys % n], self.lang) if len(keys) else np.zeros(0, np.int64)
        known = ((frequent[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        name = np.full(len(self.id), -1, np.int64)  # the frequent phrase of the last size at each place, by number
        name[at] = np.where(known[which], which, -1)
        good = name >= 0
        parts = [keys // n, keys % n]
        for k in range(3, LONGEST + 1):
            size = len(name) - k + 1
            if size <= 0:
                return
            at = np.flatnonzero((name[:size] >= 0) & good[k - 2 : k - 2 + size])
            keys, f, which = _sums(name[at] * n + self.id[at + k - 1], self.m[at])
            parts = [*(p[keys // n] for p in parts), keys % n]
            yield from sliced(self.batch, f, lambda a, b, parts=parts: self.named(*[p[a:b] for p in parts]))
            name = np.full(len(self.id), -1, np.int64)
            name[at] = which


def sliced(batch, f: np.ndarray, phrases, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(f), rows):
        yield batch(phrases(a, a + rows), f[a : a + rows])


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def pair_bits(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    """The place of a pair in the bit set, from its words' hashes."""
    h = (first ^ np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15) + second
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of bounded size, each of one language."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut() -> Iterator[Block]:
        t = pa.Table.from_batches(held).combine_chunks()
        for lang in pc.unique(t["lang"]).to_pylist():
            own = t.filter(pc.equal(t["lang"], lang)).combine_chunks()
            yield Block(lang, own["piece"].chunk(0), own["m"].to_numpy())

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > BLOCK:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def counted(parts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of all phrases with at least ``least`` occurrences: duckdb sums each hash bucket out of core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        folder = tempfile.mkdtemp(prefix="phrases-")
        db = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
        try:

            def rest() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            bucket = pa.RecordBatchReader.from_batches(first.schema, rest())  # noqa: F841
            found = db.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM bucket GROUP BY lang, phrase HAVING sum(f) >= {least}")
            for b in found.to_arrow_reader(50_000):
                yield b.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return parts.repartition("lang", "phrase").mapInArrow(run, _COUNTS)


def frequent_pairs(counts: DataFrame) -> np.ndarray:
    """The bit set of the pairs in ``counts``: at most ``FILTER_BITS`` bits reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                own = pc.split_pattern(b.filter(pc.equal(b.column(0), lang)).column(1), " ")
                h = word_hashes(own.flatten()).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair_bits(h[:, 0], h[:, 1], lang))], ["bit"])

    bits = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase").mapInArrow(run, "bit long")
    place, mask = F.expr("shiftright(bit, 6)"), F.expr("shiftleft(1L, cast(bit % 64 as int))")
    found = bits.groupBy(place.alias("place")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[found["place"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def phrase_counts(found: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of all words and phrases with at least ``least`` occurrences in ``found`` (a written table of ``pieces``)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from block.short()

    own = found.select("lang", "piece", "m")
    shorter = written(counted(own.mapInArrow(short, _COUNTS), least), "phrases-short")
    known = own.sparkSession.sparkContext.broadcast(frequent_pairs(shorter))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from block.long(known.value)

    return shorter.unionByName(counted(own.mapInArrow(long, _COUNTS), least))


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _wide(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases in ``counts`` (a written table): the lowest-scoring cut, ties to the earliest."""
    asked = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = asked.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _joined(F.col("w"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("part")),
    )
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", F.struct("lang", "s.part").alias("part"))
    requests = written(requests, "phrase-requests")
    parts = counts.select(F.struct("lang", F.col("phrase").alias("part")).alias("part"), "f").join(
        requests.groupBy("part").agg(F.count("*").alias("asked")), "part"
    )
    met = join_groups(requests, parts, "part", "asked", requests.count())
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    both = met.groupBy("lang", "phrase", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    product = _wide(F.lit(2_000_000)) * _wide(F.col("a"))
    both = both.withColumn("product", product).withColumn("whole", _wide(F.col("l")) + _wide(F.col("r")))
    both = both.withColumn("score", F.expr("product div whole"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def free_standing(candidates: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Candidates without those that a longer one holds and that hardly occur outside of it. The longer one may itself go."""
    w = F.split("phrase", " ")
    spans = [(k, at) for k in range(2, LONGEST) for at in range(1, LONGEST - k + 2)]
    own = F.filter(F.array(*[F.when(F.lit(k + at - 1) <= F.size(w), F.when(F.lit(k) < F.size(w), _joined(w, at, k))) for k, at in spans]), lambda x: x.isNotNull())
    longer = candidates.select("lang", F.explode(own).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = candidates.join(longer, ["lang", "phrase"], "left")
    return met.where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * inside)).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; a null text is empty, a null language is ``und``; other columns don't matter and
    repeated rows count as often as they stand there. Phrases are told apart by case outside A-Z. ``least`` must be 1
    or more. Ties in score and count go to the phrase that is first in UTF-8 byte order. A language without candidates has no row.
    """
    found = written(pieces(docs), "pieces")
    counts = written(phrase_counts(found, least), "phrases")
    words = F.length("piece") - F.length(F.regexp_replace("piece", " ", "")) + 1
    n = found.groupBy("lang").agg(F.sum(F.col("m") * words).alias("n"))
    n = written(n, "phrase-words")
    discard(found)
    rows = written(scored(counts), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free_standing(rows, inside).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
