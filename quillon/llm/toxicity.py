"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

The features are lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates of the whole text. The lexicon is a list of common insults, widened by
words and stems that the labelled sample marks. Trees, calibration and lexicon are fitted on a
bounded sample of labelled rows; scoring reads every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, blocks, byte_views, discard, row_sums, written

# Common insults and second-person words.
INSULTS = (
    "clown disgusting dumb dumbass fool garbage idiot idiotic imbecile jerk loser losers moron moronic "
    "pathetic scum stupid trash ugly vermin worthless wretch idiota imbécil estúpido basura connard crétin "
    "idiote imbécile stupide dumm idioten abschaum arschloch blödmann"
).split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te ti vous vos votre du dich dir dein deine ihr euch usted ustedes vosotros".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "log_words hits hit_density near_density burst_density distinct_hits obfuscated_hits obfuscated_density "
    "capitals shout punctuation exclaim digits symbols non_ascii"
).split()
NEAR = 6
#: Lengths of the word beginnings that are tried as stems.
STEMS = (4, 5, 6, 7, 8)
BURST = 50

_WORD = re.compile(r"\S+")
_PIVOT = re.compile(r"[0-9@$!*._\-](?=[a-z])")  # what stands for a letter, or parts letters
_PLAIN = re.compile(r"[^a-z0-9@$!]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")

# byte classes: 1 capital, 2 other letter, 3 exclamation mark, 4 other punctuation, 5 digit, 6 symbol, 7 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    if _c.isupper():
        _CLASS[_b] = 1
    elif _c.islower():
        _CLASS[_b] = 2
    elif _c == "!":
        _CLASS[_b] = 3
    elif _c in ".,;:?'\"()-":
        _CLASS[_b] = 4
    elif _c.isdigit():
        _CLASS[_b] = 5
    elif _b > 32:
        _CLASS[_b] = 6
_CLASS[128:] = 7


def bare(word: str) -> str:
    """A lower-cased word without digits and punctuation at its edges."""
    return _EDGE.sub("", word)


class Features:
    """Turns whole texts into rows of ``FEATURES``. A lexicon's entry that ends in * is a stem."""

    def __init__(self, lexicon: list[str]):
        import ahocorasick

        self.lexicon = frozenset(w for w in lexicon if not w.endswith("*"))
        self.stems = frozenset(w[:-1] for w in lexicon if w.endswith("*"))
        self.sizes = sorted({len(w) for w in self.stems})
        self.find = ahocorasick.Automaton()
        for w in self.lexicon | self.stems:
            self.find.add_word(w, len(w))
        if lexicon:
            self.find.make_automaton()

    def hit(self, word: str) -> bool:
        return word in self.lexicon or any(word[:n] in self.stems for n in self.sizes)

    def text(self, text: str) -> list[float]:
        low = text.lower()
        hits, obfuscated = [], 0
        if len(self.find) and next(self.find.iter(low), None) is not None:
            words = [bare(w) for w in _WORD.findall(low)]
            at = [i for i, w in enumerate(words) if self.hit(w)]
            hits = [words[i] for i in at]
        if _PIVOT.search(low):
            for w in filter(_PIVOT.search, _WORD.findall(low)):
                plain = _PLAIN.sub("", w)
                if plain not in hits and (plain in self.lexicon or plain.translate(LEET) in self.lexicon):
                    obfuscated += 1
        if not hits:
            return [0, 0, 0, 0, obfuscated]
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        burst, j = 0, 0
        for k, i in enumerate(at):
            while at[j] < i - BURST:
                j += 1
            burst = max(burst, k - j + 1)
        return [len(hits), near, burst, len(set(hits)), obfuscated]

    def rows(self, texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("") if texts.null_count else texts
        raw, off = byte_views(texts)
        kind = _CLASS[raw]
        n = np.maximum(1, off[1:] - off[:-1])
        count = {k: row_sums(kind == k, off) for k in (1, 2, 3, 4, 5, 6, 7)}
        space = raw <= 32
        words = row_sums(space, off) + 1
        own = np.array([self.text(t) for t in texts.to_pylist()], float).reshape(-1, 5)
        letters = np.maximum(1, count[1] + count[2])
        pairs = (kind[1:] == 1) & (kind[:-1] == 1)
        shout = row_sums(np.concatenate([pairs, [False]]) if len(raw) else np.zeros(0, bool), off)
        return np.column_stack(
            [
                np.log1p(words), own[:, 0], 1000 * own[:, 0] / words, 1000 * own[:, 1] / words, own[:, 2], own[:, 3],
                own[:, 4], 1000 * own[:, 4] / words, count[1] / letters, shout / letters,
                (count[3] + count[4]) / n, count[3] / n, count[5] / n, count[6] / n, count[7] / n,
            ]
        )


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss; nodes in heap order."""

    base: float
    rate: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        every = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[every, f[node]] > c[node])
            out += self.rate * leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0) -> Trees:
    """Newton boosting over histograms. A node that can't split sends all rows left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    every, features, cuts, values = np.arange(len(y)), [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        f, b, c = np.zeros(inner, int), np.full(inner, 1 << 30), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                at = (node - first) * k + binned[:, j]
                gs = np.bincount(at, g, wide * k).reshape(wide, k).cumsum(1)
                hs = np.bincount(at, h, wide * k).reshape(wide, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                cut = gain[:, :-1].argmax(1)
                top = gain[np.arange(wide), cut]
                for w in np.flatnonzero(top > best):
                    best[w], f[first + w], b[first + w], c[first + w] = top[w], j, cut[w], e[cut[w]]
            node = 2 * node + 1 + (binned[every, f[node]] > b[node])
        leaf = -np.bincount(node - inner, g, leaves) / (np.bincount(node - inner, h, leaves) + l2)
        margin += rate * leaf[node - inner]
        features.append(f), cuts.append(c), values.append(leaf)
    return Trees(base, rate, np.array(features), np.array(cuts), np.array(values))


@dataclass
class Isotonic:
    """A monotone map by pooled neighbours, linear between the pools."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, self.x, self.y)


def fit_isotonic(v: np.ndarray, y: np.ndarray) -> Isotonic:
    order = np.argsort(v, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of v
    for a, b in zip(v[order], y[order], strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    p = np.array(pools) if pools else np.array([[0.5, 1, 0.0]])
    return Isotonic(p[:, 2] / p[:, 1], (p[:, 0] + 0.02) / (p[:, 1] + 0.04))


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: Trees
    isotonic: Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the uncalibrated probability to order the rows of a pool."""
        m = self.trees.margin(x)
        return np.clip(0.999 * self.isotonic(m) + 0.001 / (1 + np.exp(-m)), 0, 1)


#: Quarters of the sample by which the calibration is fitted.
FOLDS = 4


def _features(lexicons: list[list[str]], keep: list[str]):
    """Features of every text under each lexicon, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Features(x) for x in lexicons]
        for b in batches:
            for at, end in blocks(b.column("text")):
                part = b.slice(at, end - at)
                x = np.column_stack([m.rows(part.column("text")) for m in made])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], lists], [*keep, "x"])

    return run


def lexicons(sample: DataFrame, words: int, min_count: int, min_evidence: float) -> list[list[str]]:
    """One lexicon for each fold, from the labels of the other folds alone, and a last one from all.

    Words and their beginnings count by how much the labels of the texts that have them depart from the base rate.
    """
    words_of = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.char_length(x).between(3, 30)))

    def units(w: Column) -> Column:
        return F.array(w, *[F.when(F.char_length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS])

    folds = [*range(FOLDS), -1]
    inside = lambda k, c: F.sum(F.when(F.col("fold") != k, c).otherwise(0.0))
    sums = [f for k in folds for f in (inside(k, F.col("y")).alias(f"bad{k}"), inside(k, F.lit(1.0)).alias(f"all{k}"))]
    base = sample.agg(*sums).first().asDict()
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    seen = (
        sample.select("y", "fold", words_of.alias("words"))
        .select("y", "fold", F.explode(F.array_distinct(F.array_compact(F.flatten(F.transform("words", units))))).alias("w"))
        .groupBy("w")
        .agg(*sums)
        .where(f"`bad-1` >= {min_count}")
    )
    seen = written(seen, "word-labels")
    out = []
    for k in folds:
        bad, every = F.col(f"`bad{k}`"), F.col(f"`all{k}`")
        rate = max(1.0, base[f"bad{k}"] or 0) / max(1.0, base[f"all{k}"] or 0)
        best = (
            seen.where((bad >= min_count) & (bad / every > 4 * rate))
            .withColumn("evidence", 2 * (term(bad, every * rate) + term(every - bad, every * (1 - rate))))
            .where(F.col("evidence") >= min_evidence)
            .orderBy(F.desc("evidence"), "w")
            .limit(words)
        )
        out.append(sorted({*INSULTS, *(r["w"] for r in best.select("w").collect())}))
    discard(seen)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, words: int = 600, min_count: int = 5, min_evidence: float = 24.0) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows, those with the smallest hashes of their ids.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; rows with a null label or id
    are left out, of several labels of one id the largest counts, and texts that occur
    more than once in the sample count once. The calibration is fitted on margins from a lexicon and trees
    that haven't seen the row's label, by quarters. Without any labelled row every text scores the same, below 0.001.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = own.join(F.broadcast(marked), "doc_id").groupBy(F.xxhash64("text").alias("key")).agg(
        F.max_by("text", F.struct("y", "doc_id")).alias("text"), F.max("y").alias("y")
    )
    sample = written(sample.withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")), "toxicity-sample")
    known = lexicons(sample, words, min_count, min_evidence)
    got = sample.select("key", "y", "fold", "text").mapInArrow(_features(known, ["key", "y", "fold"]), "key long, y double, fold int, x array<double>").toPandas()
    got = got.sort_values("key")
    discard(sample)
    if not len(got):
        flat = Trees(0.0, 0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)))
        return ToxicityModel(known[-1], flat, Isotonic(np.array([0.0]), np.array([0.0])))
    every, y, fold = np.array(got["x"].tolist()), got["y"].to_numpy(), got["fold"].to_numpy()
    n = len(FEATURES)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        out, x = fold == k, every[:, n * k : n * (k + 1)]
        if out.any() and not out.all():
            margin[out] = fit_trees(x[~out], y[~out]).margin(x[out])
    return ToxicityModel(known[-1], fit_trees(every[:, n * FOLDS :], y), fit_isotonic(margin, y))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], prefix: str = "", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of every whole text; null counts as empty.

    Repeated rows get equal scores; an empty table gives none. The new name takes ``prefix``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        m = shared.value
        features = Features(m.lexicon)
        return lambda texts: [pa.array(m.scores(features.rows(texts)))]

    return appended(docs, keep, text_col, make, [(prefix + "score", "double")])
