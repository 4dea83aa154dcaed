"""Conflict-constrained best-fit packing of texts into sequences of a fixed length.

Bins are kept in the order of their residual space. Each carries a bitmap of its sources
and one of its duplicate clusters; a bin takes at most one text of a cluster and one of a
source. For a text, the search starts at the tightest bin with room and goes on to the
successors until it finds a compatible one; else a new bin opens.

Texts are dealt to shards of about ``SHARD_ROWS`` texts by their place in the written table of lengths, so no id, source or
cluster can make a shard large, and are packed there, the longest first. Texts longer than a bin are cut into full
bins and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a bin, in words.
CAPACITY = 2_048
SHARD_ROWS = 4_096


#: A source or cluster with more pieces in a shard has its own order of the bins that it isn't in.
COMMON = 64


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the order given; no piece is longer than ``capacity``. Bins count from 0.

    The search for a piece of a common source or cluster goes over the bins without it alone, so many pieces that conflict with
    each other don't walk past all their bins each time.
    """
    keys = [(("s", s), ("c", c)) for s, c in zip(sources, clusters, strict=True)]
    often = Counter(k for pair in keys for k in pair)
    bins: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    order: list[tuple[int, int]] = []  # residual, bin; ties go to the older bin
    free: dict[tuple[str, int], list[tuple[int, int]]] = {k: [] for k, n in often.items() if n > COMMON}
    within: list[set[tuple[str, int]]] = []  # the common keys in a bin

    def orders(b: int) -> list[list[tuple[int, int]]]:
        return [order, *(own for k, own in free.items() if k not in within[b])]

    for need, source, cluster, pair in zip(lengths, sources, clusters, keys, strict=True):
        s, c = 1 << source, 1 << cluster
        look = min((free[k] for k in pair if k in free), key=len, default=order)
        at = bisect_left(look, (need, -1))
        while at < len(look):
            _, b = look[at]
            if not (source_bits[b] & s or cluster_bits[b] & c):
                break
            at += 1
        if at < len(look):
            room, b = look[at]
            for own in orders(b):
                del own[bisect_left(own, (room, b))]
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
            within.append(set())
        source_bits[b] |= s
        cluster_bits[b] |= c
        within[b].update(k for k in pair if k in free)
        if room > need:  # a full bin takes nothing more
            for own in orders(b):
                insort(own, (room - need, b))
        bins.append(b)
    return bins


def pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of the pieces of all texts; an empty text is one piece of length 0."""
    n = np.maximum(1, -(-lengths // capacity))
    row = np.repeat(np.arange(len(lengths)), n)
    first = (np.arange(len(row)) - np.repeat(n.cumsum() - n, n)) * capacity
    return row, first, np.minimum(capacity, lengths[row] - first)


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("length", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        row, first, size = pieces(table["length"].to_numpy(), capacity)
        order = np.lexsort((first, row, -size))
        row, first, size = row[order], first[order], size[order]
        code = [np.unique(table[c].to_numpy(), return_inverse=True)[1][row].tolist() for c in ("source", "cluster")]
        bins = np.array(pack(size.tolist(), *code, capacity), np.int64)
        shard = table["shard"].to_numpy()[row]
        return pa.table({"id": table["id"].take(pa.array(row)), "start": first, "length": size, "shard": shard, "bin": bins})

    return run


def words(text: Column) -> Column:
    """How many words a text has, parted by ASCII blanks; null has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: id, start, length, shard, bin.

    ``length`` defaults to the words of text, ``source`` to the column source and
    ``cluster`` to a hash of the text with A-Z lower-cased (so exact copies conflict). Null
    sources are one source; a null text is empty and takes a place of length 0 in some bin.
    Pieces of one text conflict with each other, having one source. Ties in length go to the
    smaller id; rows with a null id are packed too, and come last. (shard, bin) names a bin; shards follow the
    order in which rows are read, so another partitioning of the table gives other bins of the same kind.
    """
    from .common import ascii_lower, written

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(length if length is not None else words(F.col("text")), F.lit(0)).cast("long").alias("length"),
        F.xxhash64(source if source is not None else F.col("source")).alias("source"),
        F.xxhash64(cluster if cluster is not None else ascii_lower(text)).alias("cluster"),
    )
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "lengths")
    # a text of many bins counts as so many rows of its shard
    n = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("length") / capacity)))).first()[0] or 0
    shards = max(1, -(-n // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")).drop("place")
    out = dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), "id long, start long, length long, shard int, bin long")
    return out.withColumnRenamed("id", id_col)


def waste(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Bins, words and the share of the bins' space that stays empty."""
    b = packed.groupBy("shard", "bin").agg(F.sum("length").alias("filled"))
    return b.agg(F.count("*").alias("bins"), F.sum("filled").alias("words"), (1 - F.sum("filled") / (F.count("*") * capacity)).alias("waste"))
