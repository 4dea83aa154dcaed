"""SimHash near-dedup through vantage-point trees.

Fingerprints are parted by Hamming distance: a node of a tree has a vantage point and a
cut; what lies within the cut plus the radius goes to the inner child, what lies beyond the
cut to the outer one. By the triangle inequality two fingerprints within the radius differ
by no more than it in their distance from the vantage point, so both are in one child; what
lies between cut and cut plus radius overlaps the boundary and goes to both. The nodes are
fitted on a bounded sample; every fingerprint is routed down them to its shards, which are
searched by the same tree further down until few are left, and those are compared.

Distances of unrelated 64-bit fingerprints crowd at 32 +- 4, so over whole fingerprints the
bound prunes next to nothing at radius 4. The forest therefore has one tree for each slice of the bits:
of ``radius // 2 + 1`` slices, two fingerprints within the radius differ by at most one bit on one of them
at least. A tree measures the Hamming distance on its slice and searches at radius 1, where the
bound prunes; pairs that meet are compared as whole fingerprints. This is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, appended, byte_views, discard, free, join_groups, named, one_each, repeated, written

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints that a shard is expected to have, and the most that one task compares: a larger shard is split into pairs of blocks.
SHARD_ROWS = 4_096
MOST_ROWS = 65_536
#: In a shard the tree goes on until so many are left.
LEAF = 128
#: Trees are fitted on at most this many fingerprints, those with the smallest hashes.
SAMPLE = 1 << 18
#: Hashes are counted in steps of this many, below the 16-bit lanes' limit.
STEP = 32_768

_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
# a nibble's four bits in four lanes of 16 bits
_LANES = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)


# -- fingerprints -----------------------------------------------------------------


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of the word shingles of a UTF-8 text, A-Z lower-cased, words parted by ASCII blanks."""
    from xxhash import xxh64_intdigest as xxh

    parts = text.translate(_BYTES).split()  # bytes.split() parts at exactly x20, x09-x0D
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of ``sizes`` rows of hashes (rows x words of 64 bits) the bits that over half of them have; 0 for none."""
    out = np.zeros((len(sizes), h.shape[1]), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // STEP)
    first = pieces.cumsum() - pieces
    starts = np.repeat(n.cumsum() - n, pieces) + STEP * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for w in range(h.shape[1]):
        for i in range(16):
            lanes = np.add.reduceat(_LANES[((h[:, w] >> np.uint64(4 * i)) & np.uint64(15)).astype(np.intp)], starts)
            for b in range(4):
                count = np.add.reduceat((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF), first).astype(np.int64)
                out[full, w] |= (2 * count > n).astype(np.uint64) << np.uint64(4 * i + b)
    return out


def as_nodes(fp: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values, each word with its high byte first."""
    raw = fp.astype(">u8").tobytes()
    size = 8 * fp.shape[1]
    offsets = np.arange(0, len(raw) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def of_nodes(nodes: pa.Array, words: int | None = None) -> np.ndarray:
    """The opposite of ``as_nodes``: all words, or the first ``words``."""
    if not len(nodes):
        return np.zeros((0, words or 1), np.uint64)
    raw, off = byte_views(nodes)
    return np.ascontiguousarray(raw.view(">u8").astype(np.uint64).reshape(len(nodes), int(off[1] - off[0]) // 8)[:, :words])


def _fingerprints(words: int) -> Callable:
    def of(texts: pa.Array) -> list[pa.Array]:
        each = [shingle_hashes(t, words) for t in texts.fill_null("").cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return [as_nodes(majority(np.array([x for own in each for x in own], np.uint64)[:, None], sizes))]

    return of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, node) for every row: the 64-bit fingerprint as eight bytes; null and wordless texts have zero."""
    rows = docs.select(named([id_col])[0].cast("long").alias("id"), named([text_col])[0].alias("t"))
    return appended(rows, ["id"], "t", lambda: _fingerprints(words), [("node", "binary")])


# -- vantage-point trees -------------------------------------------------------------


@dataclass
class Slice:
    """Bits ``first`` to ``first + bits`` of a fingerprint, and the radius on them."""

    first: int
    bits: int
    radius: int

    def of(self, fp: np.ndarray) -> np.ndarray:
        w, off = divmod(self.first, 64)
        v = fp[:, w] >> np.uint64(off)
        if off + self.bits > 64:
            v = v | fp[:, w + 1] << np.uint64(64 - off)
        return v & np.uint64((1 << self.bits) - 1)


def slices(bits: int, count: int, radius: int) -> list[Slice]:
    """``count`` slices of ``bits`` bits, as even as can be, each searched at ``radius``."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [Slice(a, b - a, radius) for a, b in zip(cuts, cuts[1:], strict=False)]


def exact_slices(bits: int, radius: int) -> list[Slice]:
    """Slices such that a pair within ``radius`` bits is within the slice's radius on one at least."""
    count = radius // 2 + 1
    return slices(bits, count, radius // count)


def split(value: np.ndarray, radius: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(vantage point, cut, inner, outer) for the values, or none if a child would hold nearly all.

    Of a few vantage points the one whose distances spread most is taken, and the cut that makes the larger child smallest.
    """
    n = len(value)
    some = value[:: max(1, n // 5)][:5]
    d = np.bitwise_count(value[None, :] ^ some[:, None]).astype(np.int64)
    k = int(d.var(1).argmax())
    have = np.bincount(d[k], minlength=66 + radius).cumsum()
    larger = np.maximum(have[radius : radius + 65], n - have[:65])
    cut = int(larger.argmin())
    if larger[cut] > 0.9 * n:
        return None
    return int(some[k]), cut, np.flatnonzero(d[k] <= cut + radius), np.flatnonzero(d[k] > cut)


@dataclass
class Tree:
    """Nodes of one slice's tree: vantage points, cuts and children; a child below zero is the shard -1 - child."""

    slice: Slice
    vantage: np.ndarray
    cut: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shards: int

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that a fingerprint belongs to."""
        value = self.slice.of(fp)
        row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        rows, shards = [], []
        if not len(self.vantage):
            return row, node
        while len(row):
            d = np.bitwise_count(value[row] ^ self.vantage[node])
            inner, outer = d <= self.cut[node] + self.slice.radius, d > self.cut[node]
            row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([self.inner[node[inner]], self.outer[node[outer]]])
            done = node < 0
            rows.append(row[done]), shards.append(-1 - node[done])
            row, node = row[~done], node[~done]
        return np.concatenate(rows), np.concatenate(shards)


def fit_tree(s: Slice, fp: np.ndarray, total: int, shard_rows: int = SHARD_ROWS) -> Tree:
    """A tree on the sample ``fp`` of ``total`` fingerprints, with shards of about ``shard_rows``."""
    value, each = s.of(fp), total / max(1, len(fp))
    nodes: list[list[int]] = []
    shards = 0
    work: list[tuple[np.ndarray, int, int]] = [(np.arange(len(fp)), -1, 0)]  # sample, parent, side
    while work:
        at, parent, side = work.pop()
        found = split(value[at], s.radius) if len(at) * each > shard_rows and len(at) >= 16 else None
        if found:
            name = len(nodes)
            nodes.append([found[0], found[1], 0, 0])
            work += [(at[found[2]], name, 2), (at[found[3]], name, 3)]
        else:
            shards += 1
            name = -shards
        if parent >= 0:
            nodes[parent][side] = name
    table = list(zip(*nodes, strict=True)) or [()] * 4
    return Tree(s, np.array(table[0], np.uint64), *(np.array(c, np.int64) for c in table[1:]), max(1, shards))


class Search:
    """The links within ``radius`` bits in one shard: a spanning forest of them, the closest first.

    Counts its vantage points and the pairs that it compared.
    """

    def __init__(self, fp: np.ndarray, s: Slice, radius: int):
        self.fp, self.value, self.s, self.radius = fp, s.of(fp), s, radius
        self.vantages = self.compared = 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of all pairs of ``a`` and ``b``, whole fingerprints."""
        self.compared += len(a) * len(b)
        out = np.zeros((len(a), len(b)), np.uint16)
        for w in range(self.fp.shape[1]):
            out += np.bitwise_count(self.fp[a, w][:, None] ^ self.fp[b, w][None, :])
        return out

    def run(self, at: np.ndarray) -> None:
        work = [at]
        while work:
            at = work.pop()
            if len(at) <= LEAF:
                self.compare(at, at)
            elif found := split(self.value[at], self.s.radius):
                self.vantages += 1
                work += [at[found[2]], at[found[3]]]
            else:
                self.dense(at)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair, in blocks."""
        for x in range(0, len(a), 1024):
            for y in range(0, len(b), 1024):
                d = self.distances(a[x : x + 1024], b[y : y + 1024])
                i, j = np.nonzero((d <= self.radius) & (a[x : x + 1024, None] < b[None, y : y + 1024]))
                self.found.append((a[x + i], b[y + j], d[i, j]))

    def dense(self, at: np.ndarray) -> None:
        """Where the slice's distances part nothing, vantage points over whole fingerprints.

        The ball of half the radius about a vantage point is linked to it. By the triangle
        inequality what is within the radius of one in the ball is within three halves of it from the
        vantage point: that ring is compared with the ball, and the ball is done with.
        """
        while len(at) > LEAF:
            self.vantages += 1
            d = self.distances(at[:1], at)[0]
            near, ring = d <= self.radius // 2, (d > self.radius // 2) & (d <= self.radius + self.radius // 2)
            ball, edge = at[near], at[ring]
            self.found.append((np.full(len(ball) - 1, at[0]), ball[1:], d[near][1:]))
            for x in range(0, len(edge), 4096):
                best = np.full(len(edge[x : x + 4096]), self.radius + 1, np.uint16)
                to = np.zeros(len(best), np.int64)
                for y in range(0, len(ball), 4096):
                    e = self.distances(edge[x : x + 4096], ball[y : y + 4096])
                    k = e.argmin(1)
                    low = e[np.arange(len(k)), k]
                    closer = low < best
                    best[closer], to[closer] = low[closer], ball[y + k[closer]]
                hit = best <= self.radius
                self.found.append((to[hit], edge[x : x + 4096][hit], best[hit]))
            at = at[~near]
        self.compare(at, at)

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Between two blocks: only links that join what isn't joined yet are kept, each row's and column's closest first."""
        own = Components(len(self.fp))
        for x in range(0, len(a), 1024):
            for y in range(0, len(b), 1024):
                p, q = a[x : x + 1024], b[y : y + 1024]
                d = self.distances(p, q)
                near = d <= self.radius
                while near.any():
                    roots = [np.array([own.root(i) for i in z.tolist()]) for z in (p, q)]
                    near &= roots[0][:, None] != roots[1][None, :]
                    e = np.where(near, d, 1 << 15)
                    i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    some = [(i, e[i].argmin(1)), (e[:, j].argmin(0), j)] if len(i) else []
                    for i, j in some:
                        new = [k for k in range(len(i)) if own.link(int(p[i[k]]), int(q[j[k]]))]
                        self.found.append((p[i[new]], q[j[new]], d[i[new], j[new]]))

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what was found, a minimum spanning forest: (i, j, distance)."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        i, j, d = (np.concatenate([f[k] for f in self.found]).astype(np.int64) for k in range(3))
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((j, i, d))
        out, own = Components(len(self.fp)), []
        for k in order.tolist():
            if out.link(int(i[k]), int(j[k])):
                own.append(k)
        return i[own], j[own], d[own]


class Components:
    """Union-find over positions; the smaller root stays."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


LINK = "u binary, v binary, d int, tree int, rows long, vantages long, compared long"


def _search(slices_: list[Slice], radius: int, words: int):
    """One task's shard: rows of links, and a row without u that has the counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tree, block = int(table["tree"][0].as_py()), table["block"].to_numpy()
        nodes = table["node"].chunk(0)
        fp = of_nodes(nodes, words)
        order = np.lexsort(fp.T[::-1])
        fp, block = np.ascontiguousarray(fp[order]), block[order]
        nodes = nodes.take(pa.array(order))
        s = Search(fp, slices_[tree], radius)
        if block.min() == block.max():
            s.run(np.arange(len(fp)))
        else:  # two blocks of a shard that is too large: what is in one meets elsewhere
            s.across(np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()))
        i, j, d = s.forest()
        k = len(i)
        count = [pa.array([None] * k + [v], pa.int64()) for v in (len(fp), s.vantages, s.compared)]
        ends = [pa.concat_arrays([nodes.take(pa.array(x)), pa.nulls(1, pa.binary())]) for x in (j, i)]
        return pa.table([*ends, pa.array([*d.tolist(), None], pa.int32()), pa.array([tree] * (k + 1), pa.int32()), *count], ["u", "v", "d", "tree", "rows", "vantages", "compared"])

    return run


def _dealt(nodes: DataFrame, slices_: list[Slice], shard_rows: int, most_rows: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, shard, columns of ``nodes``, block, lo, hi) of all shards, and the written table behind them. The trees are fitted on a sample."""
    spark, names = nodes.sparkSession, ["tree", "shard", *nodes.columns]
    total = nodes.count()
    taken = min(1.0, 1.2 * SAMPLE / max(1, total))
    # a hash decides, so the sample is the same for the same nodes
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(taken * (1 << 30))).select("node").limit(SAMPLE).toArrow()
    fp = of_nodes(pa.array(sorted(sample["node"].to_pylist()), pa.binary()), words)
    trees = spark.sparkContext.broadcast([fit_tree(s, fp, total, shard_rows) for s in slices_])

    def route(batches):
        for b in batches:
            own = of_nodes(b.column("node"), words)
            for k, tree in enumerate(trees.value):
                row, shard = tree.route(own)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(shard.astype(np.int32)), *[c.take(row) for c in b.columns]], names)

    routed = written(nodes.mapInArrow(route, "tree int, shard int, " + ", ".join(f"{c} binary" for c in nodes.columns)), "routed")
    # a shard above the bound is cut into blocks; there are at most rows / most_rows of those
    large = routed.groupBy("tree", "shard").agg(F.count("*").alias("n")).where(F.col("n") > most_rows)
    large = large.select("tree", "shard", F.ceil(F.col("n") / (most_rows // 2)).cast("int").alias("k"))
    dealt = routed.join(F.broadcast(large), ["tree", "shard"], "left").withColumn("block", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")))
    # block b meets blocks 0 .. k - 1; the pair is named by its smaller and larger number
    mates = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = dealt.withColumn("mate", F.explode(mates)).select("tree", "shard", *nodes.columns, "block", F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"))
    return dealt, routed


def _words(slices_: list[Slice]) -> int:
    return -(-max(s.first + s.bits for s in slices_) // 64)


def search(nodes: DataFrame, slices_: list[Slice], radius: int, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Links (u, v, d) of the distinct binary values in column node, and the counts of each shard.

    The first bytes of a node are its fingerprint; further ones only tell nodes apart. Every node
    is routed. A shard that outgrows ``most_rows`` is cut into
    blocks and every two blocks meet in a task of their own.
    """
    words = _words(slices_)
    dealt, routed = _dealt(nodes.select("node"), slices_, shard_rows, most_rows, words)
    found = written(dealt.groupBy("tree", "shard", "lo", "hi").applyInArrow(_search(slices_, radius, words), LINK), "shard-links")
    discard(routed)
    return found


def links(nodes: DataFrame, radius: int = RADIUS, bits: int = 64) -> DataFrame:
    """(u, v), u > v: links that join all nodes within ``radius`` bits, few for each shard; exact."""
    found = search(nodes, exact_slices(bits, radius), radius)
    out = written(found.where("u is not null").select("u", "v").distinct(), "node-links")
    discard(found)
    return out


def counts(found: DataFrame) -> DataFrame:
    """Of a search, for each tree: shards, rows routed to them, vantage points in them, pairs compared, links found."""
    return found.groupBy("tree").agg(
        F.count("rows").alias("shards"), F.sum("rows").alias("routed"), F.sum("vantages").alias("vantages"),
        F.sum("compared").alias("compared"), F.max("rows").alias("largest"), F.count("u").alias("links"),
    )


# -- components and decisions ---------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the edges (u, v): alternating large-star and small-star steps.

    The root is the smallest node of the component. Every round is written to the shared
    folder; the number of rounds is logarithmic in the longest path.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        parents = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        # every node has one parent and no parent is a node with one: stars around the smallest nodes
        if parents.where("k > 1").isEmpty() and e.select("v").distinct().join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: every child goes to its parent's least parent; hubs with many children don't meet in one task
        hubs = e.groupBy("v").agg(F.count("*").alias("n")).join(parents.select(F.col("u").alias("v"), "m"), "v", "left")
        hubs = written(hubs.select("v", F.coalesce("m", "v").alias("m"), "n"), "hubs")
        large = written(join_groups(e, hubs, "v", "n", e.count()).select("u", F.col("m").alias("v")).distinct(), "large-star")
        discard(e, hubs)
        # small star: all parents of a node and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
    raise RuntimeError("components did not settle")


def grouped(groups: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """node, component_id, group_size of ``groups`` (node, least, group_size): the least of all nodes that the edges reach."""
    stars = components(edges)
    rooted = groups.join(stars, "node", "left").select("node", "least", "group_size", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "roots")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    out = written(join_groups(rooted, heads, "root", "members", total).select("node", "component_id", "group_size"), "components")
    discard(rooted)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id that can be reached over fingerprints within ``radius``
    bits. Null, empty and wordless texts have fingerprint zero and are linked like others;
    repeated rows and equal fingerprints share a component, and one id with several texts has each text's own; rows with a null id get the
    component of their fingerprint, whose id is null if no row with an id is in it. Texts
    of any length count whole; an empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    total = rows.count()
    groups = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("group_size")), "fingerprint-groups")
    met = join_groups(rows, grouped(groups, links(groups, radius), total), "node", "group_size", total)
    return met.select(F.col("id").alias(id_col), F.lower(F.hex("node")).alias("fingerprint"), "component_id")


# -- near duplicates by the Jaccard similarity of word shingles ---------------------------

#: The search is loose: 192 bits over word pairs, in slices of 24 bits searched at one bit, and a radius that the similarity checked afterwards needs.
NEAR_WORDS, NEAR_BITS, NEAR_SLICES, NEAR_RADIUS = 2, 192, 8, 32


@dataclass(frozen=True)
class Reach:
    """How far candidates are searched: bits on the whole fingerprint, and slices of it with the bits on each."""

    radius: int = NEAR_RADIUS
    count: int = NEAR_SLICES
    each: int = 1

    def slices(self) -> list[Slice]:
        return slices(NEAR_BITS, self.count, self.each)


#: Everything is a candidate of everything: exact, and quadratic.
EVERY_PAIR = Reach(NEAR_BITS, NEAR_BITS // 64, 64)
#: How many nodes of other groups are tried for a node of a doubtful group: all of them.
EXACT = (None,)
#: Rows and shingles of a block of a part, and the rows and number of blocks that a part is cut into so that several tasks have it.
PART_ROWS, PART_GRAMS, PART_TASKS, PART_CUTS = 8_192, 4_000_000, 1_024, 8
#: Rows of a block that are checked side by side, and words of 64 shingles that are looked at at once.
CHECK_ROWS, CHECK_WORDS = 256, 1 << 21
#: Links of a node that share one copy of its shingles.
FAN = 64

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; forgets them when it has 200,000."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, SEED)
        return h

    def text(self, text: bytes) -> np.ndarray:
        parts = text.translate(_BYTES).split()
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams, repeats included; of a shorter text the whole sequence's."""
    n = min(n, len(words))
    if not n:
        return words
    k = len(words) - n + 1
    h = words[:k]
    for i in range(1, n):
        h = _mixed(h) + words[i : i + k]
    return _mixed(h + np.uint64(n))


def _sketches(words: int) -> Callable:
    """Nodes: 24 bytes of fingerprint over word pairs, and eight that the set of word shingles determines."""
    known = _Words()

    def of(texts: pa.Array) -> list[pa.Array]:
        pairs, sets = [], []
        for t in texts.fill_null("").cast(pa.binary()).to_pylist():
            w = known.text(t)
            pairs.append(gram_hashes(w, NEAR_WORDS))
            sets.append(_mixed(np.unique(gram_hashes(w, words))).sum())
        h = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        lanes = np.column_stack([h, *[_mixed(h ^ _MIX[k - 1]) for k in range(1, NEAR_BITS // 64)]])
        fp = majority(lanes, np.fromiter(map(len, pairs), np.int64, len(pairs)))
        return [as_nodes(np.column_stack([fp, np.array(sets, np.uint64)]))]

    return of


def _sets(words: int) -> Callable:
    known = _Words()

    def of(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([np.unique(gram_hashes(known.text(t), words)).view(np.int64) for t in texts.fill_null("").cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))]

    return of


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """The shingles of one end of each pair. A node with many pairs has a copy for every ``FAN`` of them, and so a task."""
    fan = written(pairs.groupBy(end).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / FAN).cast("int")), "fan")
    dealt = join_groups(pairs, fan, end, "n", pairs.count()).withColumn("part", F.pmod(F.xxhash64("u", "v"), F.col("parts")).cast("int")).drop("n", "parts")
    copies = fan.join(sets.select(F.col("node").alias(end), F.col("grams").alias(name)), end)
    copies = copies.select(end, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), name)
    return dealt.join(copies, [end, "part"]).drop("part")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose ``sets`` (node, grams) have at least this Jaccard similarity; exact."""
    half = written(_with_sets(pairs, sets, "v", "b"), "pair-sets")
    both = F.size(F.array_intersect("a", "b"))
    out = written(_with_sets(half, sets, "u", "a").where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v"), "alike")
    discard(half)
    return out


#: Rows (two digests of 32 bytes) of a table that may be broadcast.
BROADCAST_LABELS = 200_000


def _few(table: DataFrame) -> DataFrame:
    """A written table marked for broadcast if it is small: then groups of any size meet it without a shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else table


class Alike:
    """Exact checks of the pairs of some rows of one task, each with a label: what is found joins labels, and pairs of joined labels are passed over."""

    def __init__(self, fp: np.ndarray, label: np.ndarray, grams: np.ndarray, size: np.ndarray, radius: int, similarity: float):
        self.fp, self.label, self.grams, self.size = fp, label, grams, size.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.radius, self.similarity = radius, similarity
        self.joined = Components(int(label.max()) + 1)
        self.found: list[tuple[int, int]] = []

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each shingle of ``rows``: the place among them, and the place in ``grams``."""
        n = self.size[rows]
        return np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)

    def _roots(self, rows: np.ndarray) -> np.ndarray:
        names, at = np.unique(self.label[rows], return_inverse=True)
        return np.fromiter(map(self.joined.root, names.tolist()), np.int64, len(names))[at]

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of rows of ``a`` and ``b`` with different labels, which are within the radius of each other."""
        both = np.union1d(a, b)
        if len(both) < 2:
            return
        row, at = self._entries(both)
        code, times = np.unique(self.grams[at], return_inverse=True, return_counts=True)[1:]
        some = times[code] > 1  # what one row alone has is shared by no pair
        row, code = row[some], code[some]
        start = np.searchsorted(row, np.arange(len(both) + 1))
        for x in range(0, len(a), CHECK_ROWS):
            self._check(a[x : x + CHECK_ROWS], b, both, row, code, start, len(times))

    def _check(self, p: np.ndarray, b: np.ndarray, both: np.ndarray, row: np.ndarray, code: np.ndarray, start: np.ndarray, top: int) -> None:
        d = np.zeros((len(p), len(b)), np.uint16)
        for w in range(self.fp.shape[1]):
            d += np.bitwise_count(self.fp[p, w][:, None] ^ self.fp[b, w][None, :])
        n, m = self.size[p][:, None], self.size[b][None, :]
        i, j = np.nonzero((d <= self.radius) & (self._roots(p)[:, None] != self._roots(b)[None, :]) & (np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9))
        if not len(i):
            return
        # a bit for each shingle of these rows
        own = np.searchsorted(both, p)
        place = np.concatenate([np.arange(start[k], start[k + 1]) for k in own.tolist()])
        known = np.unique(code[place])
        of = np.full(top, -1)
        of[known] = np.arange(len(known))
        wide = max(1, -(-len(known) // 64))
        bits = np.zeros((len(both), wide), np.uint64)
        hit = np.flatnonzero(of[code] >= 0)
        bit = of[code[hit]]
        np.bitwise_or.at(bits, (row[hit], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        left, right = own[i], np.searchsorted(both, b[j])
        step = max(1, CHECK_WORDS // wide)
        for y in range(0, len(i), step):
            shared = np.bitwise_count(bits[left[y : y + step]] & bits[right[y : y + step]]).sum(1, dtype=np.int64)
            u, v = p[i[y : y + step]], b[j[y : y + step]]
            good = shared >= self.similarity * (self.size[u] + self.size[v] - shared)
            for k, o in np.unique(np.stack([self.label[u[good]], self.label[v[good]]], 1), axis=0).tolist():
                if self.joined.link(k, o):
                    self.found.append((k, o))


def _among(radius: int, words: int, similarity: float):
    """Some parts, or two blocks of a part: the pairs of labels that alike nodes join, fewer than there are labels."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        coded = lambda c: np.unique(np.array(table[c].to_pylist(), dtype=object), return_inverse=True)
        (names, label), (parts, part) = coded("label"), coded("part")
        block, lists = table["block"].to_numpy(), table["grams"].chunk(0)
        own = Alike(of_nodes(table["node"].chunk(0), words), label, lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(), radius, similarity)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.searchsorted(part[order], np.arange(1, len(parts)))):
            if block.min() == block.max():
                own.compare(rows, rows)
            else:  # two blocks of a part that is too large: what is in one meets elsewhere
                own.compare(rows[block[rows] == block.min()], rows[block[rows] == block.max()])
        u, v = ([names[x[k]] for x in own.found] for k in (0, 1))
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def among(nodes: DataFrame, sets: DataFrame, similarity: float, reach: Reach) -> DataFrame:
    """(u, v): labels that links of at least this similarity join, few for each task, of ``nodes`` (node, part, label) with ``sets`` (node, grams).

    Every pair of nodes of one part with different labels is looked at, and checked exactly if it is within the reach's radius. Small parts share tasks; a large
    one is cut into blocks, and every two blocks meet in a task of their own.
    """
    met = written(nodes.join(sets, "node"), "doubtful-sets")
    sizes = written(met.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("g")), "part-sizes")
    cuts = F.greatest(F.ceil(F.col("n") / PART_ROWS), F.ceil(F.col("g") / PART_GRAMS), F.least(F.ceil(F.col("n") / PART_TASKS), F.lit(PART_CUTS)))
    total = sizes.agg(F.greatest(F.ceil(F.sum("n") / PART_TASKS), F.ceil(F.sum("g") / PART_GRAMS))).first()[0] or 0
    large = sizes.select("part", cuts.cast("int").alias("k")).where("k > 1")  # there are at most rows / PART_TASKS and shingles / PART_GRAMS of those
    dealt = met.join(F.broadcast(large), "part", "left")
    # parts without cuts go by their hash to as many tasks as their rows need
    own = F.xxhash64("part")
    dealt = dealt.withColumn("bin", F.when(F.col("k").isNull(), F.pmod(own, F.lit(2 * int(total) + 1))).otherwise(own)).withColumn("block", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")))
    mates = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = dealt.withColumn("mate", F.explode(mates)).select("bin", "part", "node", "label", "grams", "block", F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"))
    found = written(dealt.groupBy("bin", "lo", "hi").applyInArrow(_among(reach.radius, _words(reach.slices()), similarity), "u binary, v binary"), "group-links")
    discard(met, sizes)
    return found


def linked(pairs: DataFrame, sets: DataFrame, similarity: float, reach: Reach) -> DataFrame:
    """(node, root) of what links of at least this similarity connect. ``pairs`` (u, v) joins all that the search can reach, by few pairs.

    A pair that isn't alike may hide one that is, between others of the two groups. So where one failed, what hangs together by such pairs is a part, which
    holds all that the search can reach from it, and every pair of different groups in it is looked at.
    """
    good = alike(pairs, sets, similarity)
    failed = written(pairs.join(good, ["u", "v"], "left_anti"), "not-alike")
    stars = components(good)
    discard(good)
    if failed.isEmpty():
        discard(failed)
        return stars
    labels = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    # what failed joins groups of alike texts to parts, which are searched again
    both = failed.join(labels.toDF("u", "_a"), "u", "left").join(labels.toDF("v", "_b"), "v", "left")
    both = written(both.select("u", "v", F.coalesce("_a", "u").alias("a"), F.coalesce("_b", "v").alias("b")), "not-alike-groups")
    parts = components(both.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")).toDF("label", "part")
    alone = both.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("label")), F.struct(F.col("v").alias("node"), F.col("b").alias("label")))).alias("x"))
    known = labels.toDF("node", "label").unionByName(alone.select("x.node", "x.label")).distinct()
    parts = written(parts.unionByName(parts.select(F.col("part").alias("label"), "part").distinct()), "doubtful-groups")
    doubtful = known.join(_few(parts), "label").select("node", "part", "label")
    joins = among(doubtful, sets, similarity, reach)
    # groups that became one: their first labels go to the last
    moved = components(joins).toDF("root", "_to")
    sizes = stars.groupBy("root").agg(F.count("*").alias("_n"))
    moved = written(moved.join(sizes, "root", "left").withColumn("_n", F.coalesce("_n", F.lit(0))), "moved")
    out = join_groups(stars, moved, "root", "_n", stars.count()).select("node", F.coalesce("_to", "root").alias("root"))
    out = written(out.unionByName(moved.select(F.col("root").alias("node"), F.col("_to").alias("root"))), "stars")
    discard(failed, both, parts, joins, moved)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, reach: Reach = Reach(), tried: tuple[int | None, ...] = EXACT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of near duplicates.

    Two texts are linked if the sets of their ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least ``similarity``; groups are what links connect. Candidates come from vantage-point trees over
    192-bit fingerprints of word pairs, which differ by about 16 bits at a similarity of 0.8 and by over 50 for
    unrelated texts; ``linked`` checks them exactly, and no link within the ``reach`` of the search is lost. Texts that are near but not alike cost the square of their
    number, inside tasks. ``EVERY_PAIR`` as reach compares
    all pairs, and loses none at all. All nodes are tried, whatever rounds ``tried`` names. The row with the smallest id stays (null last); texts with equal shingle sets
    are one; null, empty and wordless texts are equal. Repeated rows and one id with several texts are decided
    by their texts. An empty table gives no rows.
    """
    key = free(docs.columns, "_node")
    size, least, touched = (free(docs.columns, f"_{c}") for c in ("group_size", "least", "touched"))
    rows = written(appended(docs, docs.columns, text_col, lambda: _sketches(words), [(key, "binary")]), "sketched")
    own_id = named([id_col])[0].cast("long")
    groups = written(rows.groupBy(F.col(key).alias("node")).agg(F.min(own_id).alias("least"), F.count("*").alias("n")), "sketch-groups")
    found = search(groups, reach.slices(), reach.radius)
    pairs = written(found.where("u is not null").select("u", "v").distinct(), "candidates")
    discard(found)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("touched", F.lit(True))
    told = groups.join(ends, "node", "left").select(F.col("node").alias(key), F.col("least").alias(least), F.col("n").alias(size), F.coalesce("touched", F.lit(False)).alias(touched))
    # of equal texts only the one with the least id can stay
    met = join_groups(rows, told, key, size, rows.count()).where(own_id.eqNullSafe(F.col(least)))
    heads = written(met, "heads")
    discard(rows)
    if again := repeated(heads, key):
        heads = one_each(heads, key, again)
    open_ = heads.where(touched)
    sets = written(appended(open_.select(F.col(key).alias("node"), named([text_col])[0].alias("t")), ["node"], "t", lambda: _sets(words), [("grams", "array<bigint>")]), "shingles")
    stars = linked(pairs, sets, similarity, reach)
    discard(pairs, sets)
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).join(groups.select("node", "least"), "node")
    members = written(members, "members")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node"))["node"].alias("best"), F.count("*").alias("n"))
    # a large group's members don't meet in one task
    gone = written(join_groups(members, best, "root", "n", members.count()).where("node <> best").select(F.col("node").alias(key)), "near-duplicates")
    discard(groups, members)
    kept = heads.where(~F.col(touched)).unionByName(open_.join(gone, key, "left_anti").select(*named(heads.columns)))
    return kept.select(*named(docs.columns))
