"""Language identification by bit-sliced Bloom filters over character n-grams.

Every slot of the filter holds one bit for each language. An n-gram sets its language's bit
in ``HASHES`` slots; a lookup ANDs those slots and so gives the set of all languages that
contain the n-gram at once. The bits of a text's n-grams are counted for each language,
corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, blocks

ORDERS = (2, 3, 4)
HASHES = 2
#: Languages are known up to this many, those with the most texts; every 64 have a table of masks of their own.
MAX_LANGUAGES = 4_096
#: Chosen rows that may be broadcast.
BROADCAST_ROWS = 200_000
#: Code points are processed in pieces of about this many, so that memory stays bounded for any text.
PIECE = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for all that isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams that start at each place, a blank counting as a letter; 0 where there is none.

    ``code`` holds folded code points. An n-gram has no blank inside and no two at its ends.
    """
    blank = code == 32
    x = code.astype(np.uint64)
    h = x * _M1
    inner = np.zeros(len(code), bool)
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            return
        k = len(code) - n + 1
        h = (h[:k] ^ (h[:k] >> np.uint64(29))) * _M2 + x[n - 1 :] * _M1
        inner = inner[:k] | (blank[n - 2 : n - 2 + k] if n > 2 else False)
        if n in ORDERS:
            bad = inner | (blank[:k] & blank[n - 1 :])
            yield np.where(bad, np.uint64(0), (h ^ (h >> np.uint64(32))) | np.uint64(1))


def _codes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of folded code points, a blank around each part of a text, and the row of each part's start."""
    fold, parts, rows, size = _folded(), [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            raw = np.frombuffer(t[max(0, at - 3) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            part = np.concatenate([[32] if at == 0 else [], fold[raw], [32] if at + PIECE >= len(t) else []]).astype(np.uint32)
            # the three code points before a later piece only complete n-grams that cross the cut
            parts.append(part), rows.append((i, len(part)))
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(parts), np.array(rows)
                parts, rows, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(rows)


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: list[np.ndarray]  # for every 64 languages a power of two of unsigned integers, one bit for each language
    false_rate: np.ndarray  # for each language, the chance that a foreign n-gram passes
    usual: int = 0  # the language with the most texts

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages, of the 64 of ``word``, that contain each n-gram."""
        slots = self.slots[word]
        size = np.uint64(len(slots) - 1)
        out = slots[(grams >> np.uint64(1)) & size]
        for k in range(1, HASHES):
            out = out & slots[(grams >> np.uint64(1 + 20 * k)) & size]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its n-grams and those that each language's filter holds."""
        total, held = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        for code, rows in _codes(texts):
            ends = rows[:, 1].cumsum()
            starts = ends - rows[:, 1]
            for n, g in zip(ORDERS, _grams(code), strict=False):
                real = g != 0
                # an n-gram that runs over into the next part has two blanks inside or at its ends
                at = np.minimum(starts, len(g) - 1)
                np.add.at(total, rows[:, 0], np.add.reduceat(real, at, dtype=np.int64))
                for word, slots in enumerate(self.slots):
                    kind = slots.dtype.type
                    m = np.where(real, self.masks(g, word), kind(0))
                    for j in range(64 * word, min(64 * word + 64, len(self.languages))):
                        bit = (m >> kind(j - 64 * word)) & kind(1)
                        np.add.at(held[:, j], rows[:, 0], np.add.reduceat(bit, at, dtype=np.int64))
        return total, held

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, ``und`` if it has no letter, and a score from 0 to 1."""
        total, held = self.counts(texts)
        share = held / np.maximum(1, total)[:, None]
        share = np.clip((share - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, 1)
        best = share.argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        best[share.max(1, initial=0) == 0] = self.usual
        some = total > 0
        sums = share.sum(1)
        score = np.where(some, share.max(1, initial=0) / np.maximum(sums, 1e-9), 0.0)
        return [self.languages[b] if s and self.languages else "und" for b, s in zip(best, some, strict=True)], np.clip(score, 0, 1)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, end in blocks(b.column("text")):
            part = b.slice(at, end - at)
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                found: list[np.ndarray] = [np.zeros(0, np.uint64)]
                for code, _ in _codes(own):
                    for g in _grams(code):
                        found.append(g[g != 0])
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, rows: int = 1_500, grams: int = 6_000) -> LanguageFilter:
    """Fit on the ``rows`` texts of each language whose ids have the smallest hashes.

    ``docs`` has doc_id, text and lang; null texts and languages are left out; of more than ``MAX_LANGUAGES``
    languages those with the most texts are known (ties: by name). A language's filter holds its ``grams`` most
    frequent n-grams (ties: smaller hash). The filter has a slot count of at least eight
    times the n-grams of all languages, up to two to the twentieth.
    """
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    counts = F.broadcast(docs.sparkSession.createDataFrame(sizes, "lang string, n long"))
    # twice as many as needed are let through by their hash, so that a window never sorts a whole language
    hashed = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h"))
    chosen = (
        hashed.join(counts, "lang")
        .where(F.col("h") < F.greatest(F.lit(1.0), F.lit(2.0 * rows + 200) / F.col("n") * float(1 << 32)))
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= rows)
        .select("doc_id", "lang")
    )
    if len(sizes) * rows <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    sample = known.join(chosen, ["doc_id", "lang"]).select("lang", "text")
    counted = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams)
    got = top.select("lang", "gram").toPandas().sort_values(["lang", "gram"])
    return build(sorted(set(got["lang"])), {k: v.to_numpy().view(np.uint64) for k, v in got.groupby("lang")["gram"]}, dict(sizes))


def build(languages: list[str], grams: dict[str, np.ndarray], texts: dict[str, int]) -> LanguageFilter:
    """The filter of the languages' n-grams; ``texts`` tells how many texts each language has."""
    total = sum(map(len, grams.values()))
    n = 1 << max(10, min(20, int(8 * max(1, total) - 1).bit_length()))
    size = np.uint64(n - 1)
    slots, fill = [], np.zeros(len(languages))
    for at in range(0, max(1, len(languages)), 64):
        own = languages[at : at + 64]
        kind = next(t for t, k in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(own) <= k)
        table = np.zeros(n, kind)
        for j, lang in enumerate(own):
            for k in range(HASHES):
                table[np.unique((grams[lang] >> np.uint64(1 + 20 * k)) & size)] |= kind(1 << j)
            fill[at + j] = ((table >> kind(j)) & kind(1)).mean() ** HASHES
        slots.append(table)
    usual = min(range(len(languages)), key=lambda j: (-texts.get(languages[j], 0), languages[j]), default=0)
    return LanguageFilter(languages, slots, fill, usual)


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str], prefix: str = "", text_col: str = "text") -> DataFrame:
    """Columns ``keep``, lang_pred and score for every whole text; null and letterless texts are ``und`` with score 0.

    A text none of whose n-grams a filter knows gets the language with the most texts, and score 0; of equal
    shares the first language by name wins. Repeated rows get equal results, an empty table none. The new names take ``prefix``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def of(texts: pa.Array) -> list[pa.Array]:
            lang, score = shared.value.predict(texts.fill_null("").to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score)]

        return of

    return appended(docs, keep, text_col, make, [(prefix + "lang_pred", "string"), (prefix + "score", "double")])
