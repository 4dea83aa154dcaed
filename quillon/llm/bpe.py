"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes each word's tokens. A token sequence is the BPE result of
its letters exactly if every adjacent pair of it is; so all adjacent pairs of a block of
words are tested at once, each different pair only the first time that it is met, and only
words with a failing pair undergo exact merging. All three steps go over many words side by
side in numpy; words of more than ``SHORT`` symbols take plain loops.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended, free, named

#: A worker forgets its words and pairs beyond this many.
MEMORY = 400_000
#: Words of at most this many symbols are matched and merged side by side.
SHORT = 40
NEVER = np.int32(1 << 30)
#: The end of a word as a symbol, after the 256 bytes.
END = 256
_SIDE = 1 << 20

# Texts with any of these are split by Python: control characters that not all libraries take for
# blanks, other blanks, a capital whose lower case is two letters, and what NFC may change.
_ODD = "[\x1c-\x1f\x85\xa0\u0130]|[^\x00-\u02ff]"


def byte_letters() -> list[str]:
    """For each byte the printable letter that stands for it in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


class WordBpe:
    """A word-level BPE with an end-of-word suffix, from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # the same pattern less its letter runs: blanks around its matches leave nothing but words
        letters = r"[\p{L}]+|"
        assert letters in split["pattern"]["Regex"]
        self.apart = "(" + split["pattern"]["Regex"].replace(letters, "") + ")"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letter = {c: b for b, c in enumerate(byte_letters())}

        def symbols(t: str) -> tuple[int, ...]:
            return (*[letter[c] for c in t[: -len(suffix)]], END) if t.endswith(suffix) else tuple(letter[c] for c in t)

        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.text = {i: s for s, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.named = pa.array([self.names.get(i, "") for i in range(max(self.names) + 1)])
        self.plain = np.array([self.ids[(b,)] for b in range(256)], np.int32)
        self.last = np.array([self.ids[(b, END)] for b in range(256)], np.int32)
        vocab = model["vocab"]
        pairs = [(vocab[a] * _SIDE + vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])]
        self.ranks = {c: (r, i) for c, r, i in pairs}
        self.result = np.array([i for _, _, i in pairs], np.int32)
        pairs.sort()
        self.codes, self.rank = np.array([c for c, _, _ in pairs], np.int64), np.array([r for _, r, _ in pairs], np.int32)
        self._trie()
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.forget()

    def _trie(self) -> None:
        """Edges ``node * 257 + symbol`` in order, their children, and the token that ends at each node."""
        nodes, edges, tokens = 1, {}, {}
        for s, i in self.ids.items():
            at = 0
            for x in s:
                at = edges.setdefault(at * 257 + x, nodes)
                nodes += at == nodes
            tokens[at] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], np.int64)
        self.token = np.full(nodes, -1, np.int32)
        self.token[list(tokens)] = list(tokens.values())

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.starts, self.used, self.pieces = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, []

    # -- words, as UTF-8 bytes ---------------------------------------------------

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of short words: tokens and, for each, the place of its word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = sizes.cumsum()
        sym = np.zeros(ends[-1] + 1, np.int64)
        sym[ends - 1] = END
        body = np.ones(ends[-1] + 1, bool)
        body[ends - 1] = body[-1] = False
        sym[body] = np.frombuffer(b"".join(words), np.uint8)
        row = np.arange(len(words))
        pos, end = ends - sizes, ends.copy()
        node, best, token = np.zeros(len(words), np.int64), pos.copy(), np.full(len(words), -1, np.int32)
        found_row, found_token = [], []
        while len(row):
            code = node * 257 + sym[pos]
            k = np.minimum(np.searchsorted(self.edge, code), len(self.edge) - 1)
            on = (self.edge[k] == code) & (pos < end)
            node = np.where(on, self.child[k], 0)
            pos = pos + on
            t = self.token[node]
            # the end mark must not be left alone
            good = on & (t >= 0) & ((pos == end) | (sym[pos] != END))
            best, token = np.where(good, pos, best), np.where(good, t, token)
            out = np.flatnonzero(~on)
            found_row.append(row[out])
            found_token.append(token[out])
            pos = np.where(on, pos, best)
            token[out] = -1
            more = on | (pos < end)
            if not more.all():
                row, pos, end, node, best, token = (x[more] for x in (row, pos, end, node, best, token))
        r, t = np.concatenate(found_row), np.concatenate(found_token)
        order = np.argsort(r, kind="stable")
        return t[order], r[order]

    def propose_long(self, word: bytes) -> list[int]:
        s, out, i = (*word, END), [], 0
        while i < len(s):
            j, t = next((j, t) for j in range(min(len(s), i + self.longest), i, -1) if j != len(s) - 1 and (t := self.ids.get(s[i:j])) is not None)
            out.append(t)
            i = j
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * _SIDE + b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[k] == code) & (b >= 0), self.rank[k], NEVER)

    def merge(self, rows: list[list[int]]) -> list[list[int]]:
        """Exact merging of short rows of symbols (as tokens): lowest rank first, leftmost among equals."""
        out: list[list[int]] = [[]] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for at in range(0, len(order), 4096):
            own = np.array(order[at : at + 4096])
            wide = len(rows[own[-1]])
            size = np.array([len(rows[i]) for i in own.tolist()])
            t = np.full((len(own), wide + 1), -1, np.int32)
            t[np.arange(wide + 1)[None, :] < size[:, None]] = [x for i in own.tolist() for x in rows[i]]
            rank = self._rank_of(t[:, :-1], t[:, 1:])
            col = np.arange(wide + 1)[None, :]
            while True:
                i = rank.argmin(1)
                low = rank[np.arange(len(own)), i]
                done = low == NEVER
                if done.any():
                    for w, x in zip(own[done].tolist(), t[done].tolist(), strict=True):
                        out[w] = x[: x.index(-1)]
                    keep = ~done
                    if not keep.any():
                        break
                    own, t, rank, i, low = own[keep], t[keep], rank[keep], i[keep], low[keep]
                each = np.arange(len(own))
                shift = np.concatenate([t[:, 1:], np.full((len(own), 1), -1, np.int32)], 1)
                t = np.where(col > i[:, None], shift, t)
                t[each, i] = self.result[low]
                drop = np.concatenate([rank[:, 1:], np.full((len(own), 1), NEVER)], 1)
                rank = np.where(col[:, :-1] >= i[:, None], drop, rank)
                rank[each, i] = self._rank_of(t[each, i], t[each, i + 1])
                p = np.flatnonzero(i > 0)
                rank[p, i[p] - 1] = self._rank_of(t[p, i[p] - 1], t[p, i[p]])
        return out

    def merge_long(self, part: list[int]) -> list[int]:
        """The same for a row of any length, by a heap over linked symbols."""
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = [(*r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := self.ranks.get(a * _SIDE + b))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], part[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(part[x] * _SIDE + part[y])):
                    heapq.heappush(heap, (r[0], x, r[1], part[x], part[y]))
        return [p for p in part if p >= 0]

    def symbols(self, word: bytes) -> list[int]:
        row = self.plain[np.frombuffer(word, np.uint8)]
        row[-1] = self.last[word[-1]]
        return row.tolist()

    def spelled(self, token: int) -> list[int]:
        """A token's letters as symbols."""
        s = self.text[token]
        return [*self.plain[list(s[:-2])].tolist(), int(self.last[s[-2]])] if s[-1] == END else self.plain[list(s)].tolist()

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair ``left * _SIDE + right`` stands when its two tokens' letters are merged exactly."""
        if len(self.fits) > MEMORY:
            self.fits.clear()
        each, back = np.unique(codes, return_inverse=True)
        known = self.fits
        fresh = [c for c in each.tolist() if c not in known]
        rows = [self.spelled(c // _SIDE) + self.spelled(c % _SIDE) for c in fresh]
        merged = self.merge(rows) if all(len(r) <= 4 * SHORT for r in rows) else [self.merge_long(r) for r in rows]
        known.update((c, m == [c // _SIDE, c % _SIDE]) for c, m in zip(fresh, merged, strict=True))
        return np.fromiter(map(known.__getitem__, each.tolist()), bool, len(each))[back]

    def whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token's own letters merge to it; one that stands alone has no pair to test."""
        each, back = np.unique(tokens, return_inverse=True)
        known = self.alone
        fresh = [t for t in each.tolist() if t not in known]
        rows = [self.spelled(t) for t in fresh]
        merged = self.merge(rows) if all(len(r) <= 4 * SHORT for r in rows) else [self.merge_long(r) for r in rows]
        known.update((t, m == [t]) for t, m in zip(fresh, merged, strict=True))
        return np.fromiter(map(known.__getitem__, each.tolist()), bool, len(each))[back]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of words without blanks, each of one byte or more."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        long = [i for i, w in enumerate(words) if len(w) > SHORT]
        out: list[list[int]] = [[]] * len(words)
        if short:
            flat, row = self.propose([words[i] for i in short])
            inside = np.flatnonzero(row[1:] == row[:-1])
            bad = inside[~self.compatible(flat[inside].astype(np.int64) * _SIDE + flat[inside + 1])] if len(inside) else inside
            size = np.bincount(row, minlength=len(short))
            lone = np.flatnonzero(size[row] == 1)
            wrong = np.unique(np.concatenate([row[bad], row[lone[~self.whole(flat[lone])]]])).tolist()
            tokens, cut = flat.tolist(), np.searchsorted(row, np.arange(len(short) + 1)).tolist()
            for k, i in enumerate(short):
                out[i] = tokens[cut[k] : cut[k + 1]]
            for k, t in zip(wrong, self.merge([self.symbols(words[short[k]]) for k in wrong]), strict=True):
                out[short[k]] = t
        for i in long:
            t = self.propose_long(words[i])
            codes = np.array(t[:-1], np.int64) * _SIDE + np.array(t[1:], np.int64)
            out[i] = t if (self.compatible(codes).all() if len(t) > 1 else self.whole(np.array(t)).all()) else self.merge_long(self.symbols(words[i]))
        return out

    # -- texts ------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The words of any text; a special token is a word as it stands, which no other word can equal."""
        out: list[str] = []
        for p in self.cut.split(text) if self.cut else [text]:
            if p in self.special:
                out.append(p)
            elif p:
                n = unicodedata.normalize("NFC", p)
                # lower-case letter by letter: a final sigma stays a plain one
                out += self.words.findall("".join(map(str.lower, n)) if "\u03a3" in n else n.lower())
        return out

    def learn(self, words: list[str]) -> None:
        plain = [w.encode() for w in words if w not in self.special]
        found = iter(self.encode_words(plain))
        rows = [[self.special[w]] if w in self.special else next(found) for w in words]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((t for r in rows for t in r), np.uint32, int(sizes.sum()))
        n, have = len(self.at), self.used
        while have + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(rows) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[have : have + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(rows)] = have + sizes.cumsum()
        self.used = have + len(flat)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        names = self.named.take(pa.array(flat))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), names)
        self.pieces += pc.binary_join(lists, " ").to_pylist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts, each text's offsets in them, and what decoding gives (tokens' names joined by blanks)."""
        odd = pc.match_substring_regex(texts, _ODD)
        if self.cut:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.cut.pattern))
        strange = {}
        if pc.any(odd).as_py():
            strange = {i: self.split(texts[i].as_py()) for i in pc.indices_nonzero(odd).to_pylist()}
            texts = pc.if_else(odd, "", texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self.apart, r" \1 "))
        flat, off = lists.flatten(), np.asarray(lists.offsets)
        off = off - off[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        real = which != (words.index("") if "" in words else -1)
        off = np.concatenate([[0], real.cumsum()])[off]
        which = which[real]
        if strange:
            place = {w: i for i, w in enumerate(words)}
            rows = np.split(which, off[1:-1])
            for i, own in strange.items():
                rows[i] = np.array([place.setdefault(w, len(place)) for w in own], np.int64)
            words = list(place)
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            which = np.concatenate(rows)
        fresh = [w for w in words if w and w not in self.at]
        if len(self.at) + len(fresh) > MEMORY:
            self.forget()
            fresh = [w for w in words if w]
        if fresh:
            self.learn(fresh)
        slot = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        pieces = self.pieces
        names = pa.array([pieces[i] if i >= 0 else "" for i in slot.tolist()], pa.string())
        k = slot[which]
        first, size = self.starts[k], self.starts[k + 1] - self.starts[k]
        ends = size.cumsum()
        ids = self.pool[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(k) else 0)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), names.take(pa.array(which))), " ")
        return ids, np.concatenate([[0], ends])[off], joined

    def decode(self, ids: list[int]) -> str:
        """As the library's decode of a file without decoder: the tokens' names, joined by blanks."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One for each worker and path."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, keep: list[str], prefix: str = "", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` (which has text), ids array<int> and decoded string for every whole text.

    Null and empty texts, and texts of blanks alone, have no ids and decode to the empty
    string; equal texts and repeated rows get equal ids. Other columns are not read; the new names take ``prefix``.
    """

    def arrays(ids: np.ndarray, off: np.ndarray, decoded: pa.Array) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32))), decoded.cast(pa.string())]

    return _run(docs, path, keep, "ids array<int>, decoded string", arrays, prefix, text_col)


def encode_digests(docs: DataFrame, path: str, keep: list[str], prefix: str = "", text_col: str = "text") -> DataFrame:
    """The same, with n_tokens long, ids_sha256 (little-endian unsigned 32-bit) and decoded_sha256."""

    def arrays(ids: np.ndarray, off: np.ndarray, decoded: pa.Array) -> list[pa.Array]:
        raw = ids.astype("<u4").tobytes()
        sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return [pa.array(np.diff(off)), pa.array(sha, pa.string()), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded], pa.string())]

    return _run(docs, path, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", arrays, prefix, text_col)


def _run(docs: DataFrame, path: str, keep: list[str], columns: str, arrays, prefix: str, text_col: str) -> DataFrame:
    fields = [(prefix + n, t) for n, t in (c.split() for c in columns.split(", "))]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        bpe = tokenizer(path)
        return lambda texts: arrays(*bpe.encode(texts.fill_null("")))

    return appended(docs, keep, text_col, make, fields)


def decode(rows: DataFrame, path: str, keep: list[str], ids_col: str = "ids", prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``rows`` (which has ids array<int>) and decoded; null ids decode to the empty string, unknown ones are skipped."""
    own = free(keep, "_ids")
    schema = T.StructType([*rows.select(*named(keep)).schema.fields, T.StructField(prefix + "decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            text = [bpe.decode(ids or []) for ids in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(text, pa.string())], schema.names)

    return rows.select(*named(keep), *[c.alias(own) for c in named([ids_col])]).mapInArrow(run, schema)
