"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last 16 bytes is less than at the 24 places before and
not more than at the 24 after. The rule looks at nearby bytes only, so an insertion moves no cut
beyond its surroundings, and cuts are more even than those of a fixed pattern of bits: a repeated
passage of 50 words has whole chunks. Chunks with equal digests are the same; a stretch of
chunks that occur earlier (smaller doc_id, then place) is a run, and anchors a repeated span: the
run is extended byte by byte against the first places of its end chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, byte_views, discard, free, join_groups, named, row_sums, written

#: Bytes that the hash at a place covers, and places on either side that a cut's hash is compared with.
WINDOW = 16
REACH = 24
#: A mismatch lies at most this far beyond the neighbouring chunk, else that chunk would have been cut and found alike.
MARGIN = 64
#: A repeated span has at least this many words.
MIN_WORDS = 20


def gear_table() -> np.ndarray:
    """256 mixed numbers of 16 bits."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.uint16)


GEAR = gear_table()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2 h + GEAR[byte], in 16 bits, so of the last 16 bytes; by doubling."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """At each place the minimum of it and the n - 1 places before; by doubling."""
    k = 1
    while k < n:
        step = min(k, n - k)
        more = h.copy()
        more[step:] = np.minimum(h[step:], h[:-step])
        h, k = more, k + step
    return h


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks end, in ascending order; every text that isn't empty ends one."""
    ends = off[1:][np.diff(off) > 0]
    if len(raw) <= 2 * REACH:
        return ends
    h = gear_hashes(raw)
    h[:-1][(raw[1:] & 0xC0) == 0x80] = 0xFFFF  # no cut within a character
    past = _least(h, REACH)
    at = np.arange(REACH, len(h) - REACH)
    found = at[(h[at] < past[at - 1]) & (h[at] <= past[at + REACH])] + 1
    row = np.searchsorted(off, found - 1, side="right") - 1
    # what is compared must not reach into another text
    found = found[(found - off[row] >= WINDOW + REACH) & (off[row + 1] - found >= REACH + 1)]
    return np.unique(np.concatenate([found, ends]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest as digest

    for b in batches:
        texts = b.column("t")
        for at, end in blocks(texts):
            raw, off = byte_views(texts.slice(at, end - at))
            stop = cuts(raw, off)
            start = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(stop) else stop
            row = np.searchsorted(off, start, side="right") - 1
            blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
            first = ~blank
            first[1:] &= blank[:-1]
            first[off[:-1][np.diff(off) > 0]] = ~blank[off[:-1][np.diff(off) > 0]]
            words = row_sums(first, np.concatenate([[0], stop]).astype(np.int64))
            size = stop - start
            room = np.diff(off)[row] - (start - off[row]) - size
            before = np.minimum(np.concatenate([[0], size[:-1]]).astype(np.int64) + MARGIN if len(size) else size, start - off[row])
            after = np.minimum(np.concatenate([size[1:], [0]]).astype(np.int64) + MARGIN if len(size) else size, room)
            data = raw.tobytes()
            d = [digest(data[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
            ids = b.column("id").slice(at, end - at).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(start - off[row]), *(pa.array(x.astype(np.int32)) for x in (size, words, before, after)), pa.array(d, pa.binary())],
                ["id", "pos", "len", "words", "before", "after", "digest"],
            )


#: A text among the rows of its id.
KEY = "struct<id:bigint,h:bigint>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (the row's id and its text's hash) and t, the text; null counts as empty."""
    text = F.coalesce(named([text_col])[0], F.lit(""))
    return docs.select(F.struct(named([id_col])[0].cast("long").alias("id"), F.xxhash64(text).alias("h")).alias("id"), text.alias("t"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (with the text's hash), pos and len (bytes of UTF-8), words that start in the chunk, before and after (bytes to extend it over), digest (128 bits)."""
    return _keyed(docs, id_col, text_col).mapInArrow(_chunks, f"id {KEY}, pos long, len int, words int, before int, after int, digest binary")


def _alike(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def extended(text: bytes, runs: list[dict]) -> list[tuple]:
    """(start, stop, words, first id, first start, copies) of one text's spans.

    ``left`` and ``right`` of a run are what stands before and after it at the first places of
    its end chunks. Spans that then overlap or touch become one.
    """
    out = []
    for r in sorted(runs, key=lambda r: r["start"]):
        a, b = r["start"], r["stop"]
        left, right = r["left"] or b"", r["right"] or b""
        a -= _alike(text[max(0, a - len(left)) : a][::-1], left[::-1])
        b += _alike(text[b : b + len(right)], right)
        while a < r["start"] and text[a] & 0xC0 == 0x80:
            a += 1
        while r["stop"] < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, r["first_id"], r["first_pos"] - (r["start"] - a), r["copies"]])
    blank = b" \t\n\v\f\r"
    return [
        # words that start in the span
        (a, b, len(text[a:b].split()) - (0 < a < b and text[a] not in blank and text[a - 1] not in blank), *rest)
        for a, b, *rest in out
    ]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "stop", "n_words", "first_id", "first_start", "copies"]
    for b in batches:
        for at, end in blocks(b.column("t")):
            part = b.slice(at, end - at)
            rows = [(i, *s) for i, (t, runs) in enumerate(zip(part.column("t").to_pylist(), part.column("runs").to_pylist(), strict=True)) for s in extended(t, runs)]
            ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, len(names)))], names)


def _around(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(place, bytes) for the distinct places asked for: ``n`` bytes before (side 0) or after (side 1) byte ``at`` of text ``id``."""
    wanted = asked.groupBy("id", "at", "side").agg(F.max("n").alias("n"))
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "side", "n")).alias("asked"))
    held = docs.join(wanted, "id").dropDuplicates(["id"])
    a = F.col("p.at").cast("int")
    n = F.col("p.n")
    got = held.select("id", "t", F.explode("asked").alias("p"))
    part = F.when(F.col("p.side") == 0, F.substring("t", F.greatest(a - n, F.lit(0)) + 1, F.least(n, a))).otherwise(F.substring("t", a + 1, n))
    return got.select(F.struct("id", F.col("p.at").alias("at"), F.col("p.side").alias("side")).alias("place"), part.alias("bytes"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each repeated span: id, start, stop (bytes), n_words, first_<id>, first_start, copies, text_hash.

    The first place of a chunk, by id and then byte, is not repeated; so the first document
    of a passage stays whole. A span is a longest stretch of repeated chunks, with what equals
    the text around the first places of its first and last chunk, and has at least ``min_words``
    words; first_<id> and first_start tell where its start was seen first,
    copies how often its first chunk was. Null and empty texts have no chunks; rows with a null id count
    as first, get no spans and extend none; repeated rows count once. One id may stand at several texts: each
    has its own spans, and text_hash (xxhash64 of the text) tells them apart. Texts are chunked twice, which costs less than to store
    all chunks. A text's chunks meet in one task, so they are bounded by the text.
    """
    seen = chunks(docs, id_col, text_col).groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "pos")).alias("first"))
    many = written(seen.where("copies > 1"), "repeated-chunks")
    total = many.agg(F.sum("copies")).first()[0] or 0
    met = join_groups(chunks(docs, id_col, text_col), many, "digest", "copies", total)
    later = met.where("copies > 1 and id.id is not null and not (id <=> first.id and pos <=> first.pos)").dropDuplicates(["id", "pos"])
    w = Window.partitionBy("id").orderBy("pos")
    # adjoining chunks share pos minus the bytes so far
    runs = later.withColumn("run", F.col("pos") - F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.groupBy("id", "run").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("stop"),
        F.min_by(F.struct("first.id", "first.pos", "copies", "before"), "pos").alias("f"),
        F.max_by(F.struct("first.id", (F.col("first.pos") + F.col("len")).alias("pos"), "after"), "pos").alias("l"),
    )
    runs = written(runs, "runs")
    discard(many)
    place = lambda c, side: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.pos").alias("at"), F.lit(side).alias("side"))
    ends = runs.select(
        "id", "start", "stop", F.col("f.id.id").alias("first_id"), F.col("f.pos").alias("first_pos"), F.col("f.copies").alias("copies"),
        F.explode(F.array(F.struct(place("f", 0).alias("place"), F.col("f.before").alias("n")), F.struct(place("l", 1).alias("place"), F.col("l.after").alias("n")))).alias("e"),
    ).select("id", "start", "stop", "first_id", "first_pos", "copies", "e.place", "e.n")
    texts = _keyed(docs, id_col, text_col).withColumn("t", F.col("t").cast("binary"))
    around = _around(ends.select("place.id", "place.at", "place.side", "n").where("id.id is not null and n > 0"), texts)
    asks = ends.groupBy("place").agg(F.count("*").alias("asks"))
    around = written(asks.join(around, "place"), "around")
    got = join_groups(ends, around, "place", "asks", ends.count())
    side = lambda s: F.max(F.when(F.col("place.side") == s, F.expr("substring(bytes, if(place.side = 0, greatest(octet_length(bytes) - n, 0) + 1, 1), n)")))
    whole = got.groupBy("id", "start", "stop", "first_id", "first_pos", "copies").agg(side(0).alias("left"), side(1).alias("right"))
    of_text = whole.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "first_id", "first_pos", "copies", "left", "right")).alias("runs"))
    spans = texts.join(of_text, "id").mapInArrow(_extend, f"id {KEY}, start long, stop long, n_words long, first_id long, first_start long, copies long")
    return spans.dropDuplicates(["id", "start"]).where(F.col("n_words") >= min_words).select(
        F.col("id.id").alias(id_col), "start", "stop", "n_words", F.col("first_id").alias(f"first_{id_col}"), "first_start", "copies", F.col("id.h").alias("text_hash")
    )


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; other columns stay as they are. Spans belong to a text by its id and hash."""
    key, hash_, cut_ = (free(docs.columns, n) for n in ("_key", "_text_hash", "_cut"))
    cut = spans.groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(hash_)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cut_))
    text = named([text_col])[0]
    raw = text.cast("binary")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cut_)),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(cut_, i - 1)["stop"]).cast("int").alias("a"),
            F.coalesce(F.get(cut_, i)["start"].cast("int"), F.octet_length(raw)).alias("b"),
        ),
    )
    left = F.concat_ws("", F.transform(pieces, lambda p: F.substring(raw, p["a"] + 1, p["b"] - p["a"]).cast("string")))
    joined = docs.join(cut, (named([id_col])[0] == F.col(key)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(hash_)), "left")
    return joined.select(*[F.when(F.col(cut_).isNull(), text).otherwise(left).alias(c) if c == text_col else named([c])[0] for c in docs.columns])
