"""Approximate nearest neighbours by inner product: score-aware quantisation, table scans, exact reranking.

Each vector is quantised in subspaces of two dimensions to four-bit codes. The quantiser is score-aware:
the part of the residual that is parallel to the vector costs ``eta`` times the
orthogonal part, since it is what changes large inner products. A query scans
the codes, block by block, through its table of partial products, keeps the best of each
block and reranks them by exact inner products. With ``cells`` above 1 vectors are also
dealt to cells by their nearest centroid and a query scans the ``probes`` best cells; this
pays where vectors form clusters, and loses neighbours where they don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block, of which the best are reranked.
CELL_ROWS = 4_096
#: Most rows of a cell that one task scans, block by block, and queries that it scans them for. Every row travels once for so many
#: queries, every query once for so many rows; their vectors take some 50 MB a task at 64 dimensions.
PART_ROWS = 65_536
CELL_QUERIES = 131_072
#: Queries whose tables are made side by side.
TABLES = 4_096


@dataclass
class Quantiser:
    centroids: np.ndarray  # cells x dimensions
    books: np.ndarray  # subspaces x 16 x 2
    eta: float

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        out = np.empty(len(x), np.int32)
        norm = (self.centroids**2).sum(1)
        for a in range(0, len(x), 8192):
            out[a : a + 8192] = (norm - 2 * x[a : a + 8192] @ self.centroids.T).argmin(1)
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return assign(_pairs(x), self.books, self.eta, 2)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Rows as subspaces of two dimensions; an odd last one gets a zero."""
    if x.shape[1] % 2:
        x = np.column_stack([x, np.zeros(len(x))])
    return x.reshape(len(x), -1, 2)


def assign(x: np.ndarray, books: np.ndarray, eta: float, rounds: int) -> np.ndarray:
    """Codes of least score-aware loss |r|^2 + (eta - 1) <r, u>^2, by coordinate descent; u is the row's direction."""
    n, m, _ = x.shape
    u = x / np.maximum(np.sqrt((x**2).sum((1, 2))), 1e-30)[:, None, None]
    err = [((x[:, s, None, :] - books[s][None]) ** 2).sum(2) for s in range(m)]
    par = [((x[:, s, None, :] - books[s][None]) * u[:, s, None, :]).sum(2) for s in range(m)]
    code = np.stack([e.argmin(1) for e in err], 1)
    each = np.arange(n)
    sums = sum(par[s][each, code[:, s]] for s in range(m))
    for _ in range(rounds):
        for s in range(m):
            rest = sums - par[s][each, code[:, s]]
            code[:, s] = (err[s] + (eta - 1) * (rest[:, None] + par[s]) ** 2).argmin(1)
            sums = rest + par[s][each, code[:, s]]
    return code.astype(np.uint8)


def train(x: np.ndarray, cells: int, seed: int = 11, threshold: float = 0.2, rounds: int = 6) -> Quantiser:
    """Centroids by k-means, codebooks by alternating score-aware assignment and least squares."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    c = x[rng.choice(n, min(cells, n), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(d)], 1)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    p = _pairs(x)
    m = p.shape[1]
    books = np.stack([p[rng.choice(n, 16, replace=n < 16), s] for s in range(m)])
    u = p / np.maximum(np.sqrt((p**2).sum((1, 2))), 1e-30)[:, None, None]
    for _ in range(rounds):
        code = assign(p, books, eta, 1)
        each = np.arange(n)
        sums = sum(((p[:, s] - books[s][code[:, s]]) * u[:, s]).sum(1) for s in range(m))
        for s in range(m):
            now = ((p[:, s] - books[s][code[:, s]]) * u[:, s]).sum(1)
            rest = sums - now
            # least squares of |x - b|^2 + (eta - 1) (rest + <x, u> - <b, u>)^2 for each code
            us, k = u[:, s], code[:, s]
            target = rest + (p[:, s] * us).sum(1)
            a = np.zeros((16, 2, 2))
            v = np.zeros((16, 2))
            for i in range(2):
                v[:, i] = np.bincount(k, p[:, s, i] + (eta - 1) * target * us[:, i], 16)
                for j in range(2):
                    a[:, i, j] = np.bincount(k, (i == j) + (eta - 1) * us[:, i] * us[:, j], 16)
            full = np.bincount(k, minlength=16) > 0
            books[s][full] = np.linalg.solve(a[full] + 1e-9 * np.eye(2), v[full][:, :, None])[:, :, 0]
            sums = rest + ((p[:, s] - books[s][code[each, s]]) * us).sum(1)
    return Quantiser(c, books, eta)


def usable(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def fit(rows: DataFrame, sample: int = 8_192, cells: int = 1) -> Quantiser:
    """Fit on the ``sample`` rows (columns id, vec) whose ids have the smallest hashes.

    The dimension is the sample's most frequent one. There are at most a sixteenth as many
    cells as sampled rows.
    """
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()["vec"]
    if not len(got):
        return Quantiser(np.zeros((1, 1)), np.zeros((1, 16, 2)), 1.0)
    d = int(got.map(len).mode().iloc[0])
    x = np.array([v for v in got if len(v) == d], np.float64)
    return train(x, max(1, min(cells, len(x) // 16)))


def _cells(q: Quantiser, probes: int, query: bool):
    d = q.dimensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vec"].to_numpy()).astype(np.float64).reshape(len(b), d)
            if query:
                score = x @ q.centroids.T
                k = min(probes, score.shape[1])
                cell = np.argpartition(-score, k - 1, 1)[:, :k] if k < score.shape[1] else np.tile(np.arange(k), (len(b), 1))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), k), "vec": np.repeat(b["vec"].to_numpy(), k), "cell": cell.ravel().astype(np.int32)})
            else:
                yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "cell": q.cells(x), "code": [c.tobytes() for c in q.codes(x)]})

    return run


def inner_products(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column with ``y``, summed in the order of dimensions: equal vectors have equal products wherever they stand."""
    if not columns.shape[1]:
        return np.zeros(0)
    return np.add.accumulate(columns * y[:, None], axis=0)[-1]


def scan(q: Quantiser, top: int, keep: int):
    """Scans the codes of one block of a cell for one block of queries; returns the best of each query."""

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(rows) or not len(queries):
            return out
        rows = rows.sort_values("id", kind="stable")  # then ties go to the smaller id
        found = []
        for a in range(0, len(queries), TABLES):
            some = queries.iloc[a : a + TABLES]
            y = np.stack(some["vec"].to_numpy()).astype(np.float64)
            table = np.einsum("nsd,skd->nsk", _pairs(y), q.books).astype(np.float32)
            best = [block(some["id"].to_numpy(), y, table, rows.iloc[x : x + CELL_ROWS]) for x in range(0, len(rows), CELL_ROWS)]
            both = pd.concat(best, ignore_index=True).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            found.append(both.groupby("query_id", sort=False).head(top))
        return pd.concat(found, ignore_index=True)

    def block(asked: np.ndarray, y: np.ndarray, table: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
        """The best of each query in one block."""
        ids = rows["id"].to_numpy()
        columns = np.ascontiguousarray(np.stack(rows["vec"].to_numpy()).astype(np.float64).T)
        code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1).T
        # two four-bit codes share a byte and a table of 256 sums
        both = [(code[s].astype(np.intp) << 4) | code[s + 1] for s in range(0, len(code) - 1, 2)]
        odd = code[-1].astype(np.intp) if len(code) % 2 else None
        qs, vs, scores = [], [], []
        for i, qid in enumerate(asked):
            approx = np.zeros(len(ids), np.float32)
            for j, b in enumerate(both):
                approx += (table[i, 2 * j][:, None] + table[i, 2 * j + 1][None, :]).ravel()[b]
            if odd is not None:
                approx += table[i, -1][odd]
            approx[ids == qid] = -np.inf
            k = min(keep, len(ids))
            if k < len(ids):
                # all of the k-th's ties, so that the smaller ids among equals are there
                at = np.flatnonzero(approx >= np.partition(approx, len(ids) - k)[len(ids) - k])
            else:
                at = np.arange(len(ids))
            at = at[ids[at] != qid]
            score = inner_products(columns[:, at], y[i])
            best = np.lexsort((ids[at], -score))[:top]
            qs.append(np.full(len(best), qid)), vs.append(ids[at][best]), scores.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(qs), "vec_id": np.concatenate(vs), "score": np.concatenate(scores)})

    return run


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, keep: int = 160, cells: int = 1, probes: int = 1, quantiser: Quantiser | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its ``top`` rows of largest inner product.

    Every usable row is indexed; ``queries`` has the same columns. A query's own id is no
    candidate. Ties go to the smaller id, equal vectors are all candidates; rows with null
    ids, unusable vectors or another dimension than the sample's take no part, and of several
    rows with one id the one with the smallest vector counts. The search is exact with ``keep`` at ``CELL_ROWS`` or more and ``cells`` at 1; below that its recall is to be measured. ``probes`` cells are scanned for each query and ``keep``
    rows of each block are reranked. Fewer candidates than ``top`` in the probed cells give
    fewer rows, unless the whole table has fewer, when all are returned.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    kind = own.schema["vec"].dataType.simpleString()  # single precision stays so on the way
    q = quantiser or fit(own, cells=cells)
    # of several vectors with one id the smallest counts, for rows and queries alike
    own, asked = (x.where(F.size("vec") == q.dimensions).groupBy("id").agg(F.min("vec").alias("vec")) for x in (own, asked))
    index = written(own.mapInPandas(_cells(q, probes, False), f"id long, vec {kind}, cell int, code binary"), "vectors")
    wants = written(asked.mapInPandas(_cells(q, probes, True), f"id long, vec {kind}, cell int"), "vector-queries")
    size = index.groupBy("cell").agg(F.count("*").alias("rows"))
    # cells are few (a sixteenth of the sample at most): their sizes are a bounded table
    # as few parts as keep all cores busy: what is sent falls with the rows of a part
    part_rows = min(PART_ROWS, max(CELL_ROWS, -(-index.count() // (4 * spark.sparkContext.defaultParallelism))))
    parts = F.broadcast(size.select("cell", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts")))
    shares = F.broadcast(wants.groupBy("cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("shares")))
    index = index.join(parts, "cell").join(shares, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    index = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("cell", "part", "share", "id", "vec", "code")
    wants = wants.join(parts, "cell").join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    wants = wants.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "share", "id", "vec")
    keys = ["cell", "part", "share"]
    found = index.groupBy(*keys).cogroup(wants.groupBy(*keys)).applyInPandas(scan(q, top, keep), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
