"""Fuzzy matching that only the sequence matcher defines; Arrow batches, no row-wise calls from the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that match a phrase have a ratio of at least this: that many of so many letters of both must match.
LEAST_RATIO = 0.85
MATCHED, OF = 17, 40
#: Phrases whose runs of letters are counted side by side, entries of the table of hashed runs, and letters of a run in long windows.
SIDE_BY_SIDE = 64
TABLE, RUN = 1 << 16, 7
#: Letters of texts, and shared runs, that are worked on at once.
LETTERS, SHARED = 1 << 17, 1 << 22
#: Bits of a limb, windows whose common subsequences grow side by side, and the share of a phrase's letters that lies between windows that are bounded first.
LIMB, TOGETHER, STRIDE = 62, 1 << 13, 5
#: Share of the frequent letters, which are only counted.
FREQUENT = 0.6
#: Letters from which on the sequence matcher doesn't begin a block at a popular one, and kinds that letters fall into where they are counted.
POPULAR_FROM, KINDS = 200, 32


def normalized(text: str) -> str:
    """NFKC, case folded, all but letters and digits to blanks, squeezed."""
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs_of(codes: np.ndarray, q: int) -> np.ndarray:
    """The hash of each run of ``q`` letters; equal runs have equal ones."""
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint32)
    for x in range(q):
        h *= np.uint32(0x9E3779B1)
        h += codes[x : x + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(16)).astype(np.int32)


def _place(ordered: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of values in an ordered list without repeats; -1 for those that aren't in it."""
    if not len(ordered):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(ordered, of), len(ordered) - 1)
    return np.where(ordered[at] == of, at, -1)


class Phrases:
    """Phrases as the windowed match needs them, in order of their numbers of words; those without letters match nothing."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        text = [normalized(p) for p in phrases]
        words = np.array([len(p.split()) for p in text], np.int64)
        self.place = np.argsort(words, kind="stable")[np.count_nonzero(words == 0) :]
        self.text, self.words = [text[k] for k in self.place], words[self.place]
        self.letters, often = np.unique(_points("".join(self.text)), return_counts=True)
        others = len(self.letters)  # stands for any letter that no phrase has
        self.code = np.full(0x110000, others, np.int32)
        self.code[self.letters] = np.arange(others)
        # the most frequent letters are a kind each, the others of the phrases one together, and those of no phrase the last
        order = np.argsort(-often, kind="stable")
        self.kind = np.full(others + 1, KINDS - 1)
        self.kind[order[: KINDS - 1]] = np.arange(min(KINDS - 1, others))
        self.kind[others] = KINDS
        self.frequent = min(int(np.searchsorted(np.cumsum(often[order]), FREQUENT * often.sum())) + 1, KINDS - 1)
        every = [self.code[_points(p)] for p in self.text]
        self.kinds = np.array([np.bincount(self.kind[c], minlength=KINDS) for c in every], np.int32).reshape(-1, KINDS)
        self.size, self.masks = self._masks(every)
        self.size_of_rare, self.masks_of_rare = self._masks([c[self.kind[c] >= self.frequent] for c in every])
        self.sides = [self._index(at) for at in range(0, len(self.text), SIDE_BY_SIDE)]
        self.whole = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for k, p in enumerate(self.text):
            same.setdefault(p, []).append(k)
        for p, ks in same.items():
            self.whole.add_word(p, ks)
        if same:
            self.whole.make_automaton()

    def _masks(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of letters; and limbs x phrases and letters of bits, set where a phrase has the letter."""
        size = np.array([len(c) for c in codes], np.int64)
        masks = np.zeros((-(-int(size.max(initial=1)) // LIMB), len(codes), len(self.letters) + 1), np.uint64)
        for k, c in enumerate(codes):
            at = np.arange(len(c))
            np.bitwise_or.at(masks, (at // LIMB, k, c), np.uint64(1) << (at % LIMB).astype(np.uint64))
        return size, masks.reshape(len(masks), -1)

    def _index(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some phrases' runs: which phrases long windows may match, where each hash begins, how often it is there, and by hash the phrases, as places among those."""
        own = [k for k in range(at, min(at + SIDE_BY_SIDE, len(self.text))) if len(self.text[k]) * (OF - MATCHED) >= POPULAR_FROM * MATCHED]
        runs = [_runs_of(_points(self.text[k]), RUN) for k in own]
        # a run counts once for a phrase, however often that has it
        entry = np.unique(np.concatenate([np.zeros(0, np.int64), *(r.astype(np.int64) * SIDE_BY_SIDE + n for n, r in enumerate(runs))]))
        first = np.searchsorted(entry, np.arange(TABLE + 1) * SIDE_BY_SIDE)
        return np.array(own, np.int64), first[:-1].astype(np.int32), np.diff(first).astype(np.int32), entry % SIDE_BY_SIDE

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(place of the phrase, best ratio) where the text has the phrase, or the best ratio over windows that start at every word is high enough."""
        return sorted((k, ratio) for _, k, ratio in self.search([text]))

    def search(self, texts: Iterable[str]) -> Iterator[tuple[int, int, float]]:
        """``matches`` of many texts, each with the text's place before it; short texts are gone through together."""
        some, size = [], 0
        for n, text in enumerate(texts if self.text else ()):
            if t := normalized(text):
                some.append((n, t))
                size += len(t) + 1
            if size >= LETTERS:
                yield from self._together(some)
                some, size = [], 0
        if some:
            yield from self._together(some)

    def _together(self, some: list[tuple[int, str]]) -> Iterator[tuple[int, int, float]]:
        texts = _Texts([t for _, t in some], self)
        best = {(n, k): 1.0 for n, (_, t) in enumerate(some) for _, ks in self.whole.iter(t) for k in ks}
        whole = np.array([n * len(self.text) + k for n, k in best], np.int64)
        cuts = np.flatnonzero(np.diff(texts.start // -(-len(texts.text) // max(1, len(texts.text) // LETTERS)), prepend=-1)).tolist()
        for w0, w1 in zip(cuts, [*cuts[1:], len(texts.start)], strict=True):
            part, left = _Part(texts, w0, w1, self), []
            for at in range(0, len(self.text), SIDE_BY_SIDE):
                k, x, y, rest = self._near(part, at)
                if len(whole) and len(k):
                    more = ~np.isin(texts.of(x) * len(self.text) + k, whole)
                    k, x, y, rest = k[more], x[more], y[more], rest[more]
                if len(k):
                    left.append(self._bounded(texts, k, x, y, rest))
            if left:  # sides and their phrases are in order
                self._matched(texts, *(np.concatenate(c) for c in zip(*left, strict=True)), best)
        yield from ((some[n][0], int(self.place[k]), round(ratio, 6)) for (n, k), ratio in best.items())

    def _near(self, part: _Part, at: int) -> tuple[np.ndarray, ...]:
        """Of some phrases and the windows of a part that two bounds leave: phrases, first letters, ends, and how many frequent letters both have.

        No window that could reach the least ratio is passed over. Of two strings M letters must match, which in any order are no more than both have. In windows of
        ``POPULAR_FROM`` letters or more the sequence matcher begins no block at a letter that is popular there, but for one at the very start; so if B letters aren't, there are at most
        B + 1 blocks, and at least M - (q - 1) (B + 1) runs of q letters of the window are the phrase's too.
        """
        size, counts = self.size[at : at + SIDE_BY_SIDE], self.words[at : at + SIDE_BY_SIDE]
        few, many = MATCHED, OF - MATCHED  # strings match only if many times the shorter has few times the longer's letters
        indexed = self.sides[at // SIDE_BY_SIDE][0] - at
        runs = self._shared(part, at) if len(indexed) else None
        found: list[tuple[np.ndarray, ...]] = []
        for n in np.unique(counts).tolist():
            x, y, fine, between = part.windows(n)
            if not len(x):
                continue
            length = y - x
            long = fine & (length >= POPULAR_FROM)
            short, some = np.flatnonzero(fine & ~long), np.flatnonzero(counts == n)
            lo, hi = np.searchsorted(indexed, [some[0], some[-1] + 1]).tolist()
            could = dict.fromkeys(some.tolist())
            if lo < hi and long.any():
                limit, blocks = (length // 100 + 1).astype(runs.dtype), np.ones(len(x), runs.dtype)
                for kind in range(KINDS):  # one by one, so that what is made stays small
                    own = between(part.kinds[kind : kind + 1])[0]
                    if kind < KINDS - 1:  # the last is of several letters
                        own *= own <= limit
                    blocks += own
                least = (length * MATCHED // OF).astype(runs.dtype) - (RUN - 1) * blocks
                enough = between(runs[lo:hi]) - least >= (MATCHED * size[indexed[lo:hi]] // OF).astype(runs.dtype)[:, None]
                could |= zip(indexed[lo:hi].tolist(), enough & long, strict=True)
            if len(short):  # of fewer letters than a byte holds
                lb, room = length[short], between(part.bytes)
                room = room if len(short) == len(x) else room.take(short, 1)
            for k in some.tolist():
                la = int(size[k])
                asked = np.flatnonzero((few * lb <= many * la) & (few * la <= many * lb)) if len(short) else short
                if len(asked):
                    every = 2 * len(asked) > len(short)
                    rest, both = _in_both(room if every else room.take(asked, 1), self.kinds[at + k].tolist(), self.frequent)
                    if every:
                        rest, both = rest[asked], both[asked]
                    left = np.flatnonzero(OF * both.astype(np.int32) >= MATCHED * (la + lb[asked]))
                    w = short[asked[left]]
                    found.append((np.full(len(w), at + k, np.int32), x[w], y[w], rest[left].astype(np.int32)))
                if could[k] is not None and len(w := np.flatnonzero(could[k])):
                    w = w[(few * length[w] <= many * la) & (few * la <= many * length[w])]
                    found.append((np.full(len(w), at + k, np.int32), x[w], y[w], part.both(x[w], y[w], self.kinds[at + k, : self.frequent])))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 4

    def _shared(self, part: _Part, at: int) -> np.ndarray:
        """Indexed phrases x running numbers, by words, of the runs that begin in a word and are the phrase's too."""
        indexed, first, times, whose = self.sides[at // SIDE_BY_SIDE]
        n = times[part.runs]
        hit = np.flatnonzero(n).astype(np.int32)
        n = n[hit]
        rows, words = len(indexed), len(part.start)
        ends, counts, lo = np.cumsum(n), np.zeros(0 if len(hit) else rows * words, np.int64), 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARED, "right")))
            some = n[lo:hi]
            entry = np.repeat(first[part.runs[hit[lo:hi]]] - (ends[lo:hi] - some - (ends[lo] - some[0])), some)
            entry += np.arange(len(entry))
            more = np.bincount(whose[entry] * words + np.repeat(part.word[hit[lo:hi]], some), minlength=rows * words)
            counts, lo = counts + more if lo else more, hi
        return _running(counts, rows, part.kind)

    def _bounded(self, texts: _Texts, k: np.ndarray, x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the rare letters leave of windows: phrases, first letters and ends, by phrase and in order.

        What matches is at most the common subsequence of the rare letters, and the frequent letters that both have (``rest``). By each rare letter that another window has
        besides, the former grows by one at most. So it is measured for one of neighbouring windows first, and then for those that this leaves a chance.
        """
        if np.any((x[1:] < x[:-1]) & (k[1:] == k[:-1])):
            order = np.lexsort((x, k))
            k, x, y, rest = k[order], x[order], y[order], rest[order]
        need = -(-MATCHED * (self.size.astype(np.int32)[k] + y - x) // OF)
        group = x // np.maximum(1, self.size // STRIDE).astype(np.int32)[k]
        first = np.append(True, (k[1:] != k[:-1]) | (group[1:] != group[:-1]))
        head, own = np.flatnonzero(first), np.cumsum(first) - 1
        at = (head + np.append(head[1:], len(k)) - 1) // 2
        begin, upto = texts.rare[x], texts.rare[y]
        common = self._rare(texts, k[at], begin[at], upto[at])
        more = np.maximum(upto - upto[at][own], 0) + np.maximum(begin[at][own] - begin, 0)
        left = np.flatnonzero(common[own] + more + rest >= need)
        left = left[self._rare(texts, k[left], begin[left], upto[left]) + rest[left] >= need[left]]
        return k[left], x[left], y[left]

    def _matched(self, texts: _Texts, k: np.ndarray, x: np.ndarray, y: np.ndarray, best: dict[tuple[int, int], float]) -> None:
        """Puts into ``best`` the best ratio of each text and phrase with a window that reaches the least one."""
        left = self._placed(texts, k, x, y)
        k, x, y = k[left], x[left], y[left]
        if not len(k):
            return
        ratio, of = 2 * self._common(texts.letters, k, x, y) / (self.size[k] + y - x), texts.of(x)
        for r in np.argsort(-ratio, kind="stable").tolist():
            if ratio[r] + 1e-9 < LEAST_RATIO:
                break
            key = int(of[r]), int(k[r])
            if ratio[r] + 1e-9 >= best.get(key, LEAST_RATIO):
                own = SequenceMatcher(None, self.text[key[1]], texts.text[x[r] : y[r]]).ratio()
                if own >= LEAST_RATIO:
                    best[key] = max(best.get(key, 0.0), own)

    def _placed(self, texts: _Texts, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which windows, by phrase, the places of trigrams leave.

        M matching letters lie in at most D + 1 blocks, where D letters of both don't match, so M - 2 (D + 1) trigrams of the window are the phrase's too, and none of
        them lies more than ``lb - M`` places later or ``la - M`` earlier than there, since so many letters at most are left out on either side.
        """
        left = np.zeros(len(k), bool)
        for p in np.unique(k).tolist():
            lo, hi = np.searchsorted(k, [p, p + 1]).tolist()
            gram = _runs_of(_points(self.text[p]), 3)
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            while lo < hi:  # as many windows as have so many letters
                to = max(lo + 1, min(hi, lo + LETTERS // max(1, len(self.text[p]))))
                begin, wide = x[lo:to], y[lo:to] - x[lo:to]
                need = -(-MATCHED * (self.size[p] + wide) // OF)
                grams = np.maximum(wide - 2, 0)
                whose = np.repeat(np.arange(to - lo), grams)
                j = np.arange(len(whose)) - np.repeat(np.cumsum(grams) - grams, grams)
                which = texts.trigrams[begin[whose] + j]
                first = np.searchsorted(gram, which)
                n = np.searchsorted(gram, which, "right") - first
                entry = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                whose, later = np.repeat(whose, n), np.repeat(j, n) - order[entry]
                near = (later <= (wide - need)[whose]) & (-later <= (self.size[p] - need)[whose])
                left[lo:to] = np.bincount(whose[near], minlength=to - lo) >= 5 * need - 2 * (self.size[p] + wide) - 2
                lo = to
        return left

    def _rare(self, texts: _Texts, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of rare letters."""
        return _longest(self.masks_of_rare, self.size_of_rare, texts.rare_letters, k, x, y)

    def _common(self, letters: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of phrases ``k`` and letters ``x`` to ``y``."""
        return _longest(self.masks, self.size, letters, k, x, y)


def _longest(masks: np.ndarray, size: np.ndarray, letters: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of phrases ``k`` and letters ``x`` to ``y``; bit-parallel in limbs, the pairs side by side."""
    out, kinds = np.zeros(len(k), np.int32), masks.shape[1] // max(1, len(size))
    limbs = np.maximum(1, -(-size[k] // LIMB))
    order = np.lexsort((x - y, limbs))
    ends = np.searchsorted(limbs[order], limbs[order], "right")
    one, full = np.uint64(LIMB), np.uint64((1 << LIMB) - 1)
    letters = letters.astype(np.int64, copy=False)
    u, total, carry = np.zeros((3, TOGETHER), np.uint64)
    at = np.zeros(TOGETHER, np.int64)
    o = 0
    while o < len(k):
        own = order[o : min(o + TOGETHER, int(ends[o]))]
        n_limbs = int(limbs[own[0]])
        o += len(own)
        base, begin, long = k[own].astype(np.int64) * kinds, x[own].astype(np.int64), (y - x)[own]
        v = np.full((n_limbs, len(own)), full)
        live = np.searchsorted(-long, -np.arange(long[0]), "left")  # how many are longer than each length
        for step, n in enumerate(live.tolist()):
            place, bits, sums, over = at[:n], u[:n], total[:n], carry[:n]
            letters[step:].take(begin[:n], out=place, mode="clip")
            place += base[:n]
            for limb in range(n_limbs):
                now = v[limb, :n]
                masks[limb].take(place, out=bits, mode="clip")
                bits &= now
                np.add(now, bits, out=sums)
                if limb:
                    sums += over
                if limb + 1 < n_limbs:
                    np.right_shift(sums, one, out=over)
                    sums &= full
                now -= bits
                now |= sums
        v &= full
        out[own] = n_limbs * LIMB - np.bitwise_count(v).sum(0, dtype=np.int32)
    return out


class _Texts:
    """Texts one after another, with a line end between: their letters and words."""

    def __init__(self, texts: list[str], phrases: Phrases):
        self.text = "\n".join(texts)
        self.codes = _points(self.text)
        self.letters = phrases.code[self.codes]
        self.trigrams = _runs_of(self.codes, 3)
        self.kind = phrases.kind[self.letters]
        #: Rare letters that phrases have, and how many of them come before each letter.
        is_rare = (self.kind >= phrases.frequent) & (self.kind < KINDS)
        self.rare_letters = self.letters[is_rare].astype(np.int64)
        self.rare = np.append(0, np.cumsum(is_rare)).astype(np.int32)
        gap = np.flatnonzero((self.codes == 32) | (self.codes == 10))
        self.start, self.end = np.append(0, gap + 1).astype(np.int32), np.append(gap, len(self.codes)).astype(np.int32)
        self.begin = np.append(0, np.flatnonzero(self.codes == 10) + 1)
        self.first = np.searchsorted(self.start, self.begin)
        #: For each word the place after the last of its text.
        self.stop = np.append(self.first[1:], len(self.start))[self.of(self.start)]

    def of(self, letter: np.ndarray) -> np.ndarray:
        """The texts that letters belong to."""
        return np.searchsorted(self.begin, letter, "right") - 1


class _Part:
    """The windows of texts that begin at the words from ``w0`` to ``w1``."""

    def __init__(self, texts: _Texts, w0: int, w1: int, phrases: Phrases):
        last = min(w1 - 1 + int(phrases.words.max()), len(texts.start))
        self.many, self.texts = w1 - w0, texts
        self.start, self.end, self.stop = texts.start[w0:last], texts.end[w0:last], texts.stop[w0:last] - w0
        self.first = texts.first[(texts.first >= w0) & (texts.first < w1)] - w0
        base, upto = int(self.start[0]), int(self.end[-1])
        self.word = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, upto)))
        self.runs = _runs_of(texts.codes[base:upto], RUN)
        # of windows that could match, all that is counted of letters, runs and blocks is less than the smaller numbers hold; running numbers that pass that begin anew, so differences are right
        self.kind = np.int16 if int(phrases.size.max()) < 3_000 else np.int32
        self.kinds = _running(np.bincount(texts.kind[base:upto] * len(self.start) + self.word, minlength=(KINDS + 1) * len(self.start)), KINDS + 1, self.kind)[:KINDS]
        self.bytes = self.kinds.astype(np.uint8)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """First letters and ends of windows of ``n`` words, and which of them lie in one text; texts of fewer words, which are a window each, come last. And what gives the differences of rows of running numbers over them."""
        first = self.first[self.stop[self.first] - self.first < n]
        wide, upto = max(0, min(self.many, len(self.start) - n + 1)), self.stop[first]
        fine = np.append(np.arange(n, n + wide) <= self.stop[:wide], np.ones(len(first), bool))

        def between(running: np.ndarray) -> np.ndarray:
            own = running[:, n : n + wide] - running[:, :wide]
            return np.concatenate([own, running.take(upto, 1) - running.take(first, 1)], axis=1) if len(first) else own

        return np.append(self.start[:wide], self.start[first]), np.append(self.end[n - 1 : n - 1 + wide], self.end[upto - 1]), fine, between

    def both(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """How many letters of the first kinds both the windows from letters ``x`` to ``y`` and a phrase have, which has so many of each."""
        a, b = np.searchsorted(self.start, x), np.searchsorted(self.end, y) + 1
        return np.minimum(self.kinds[: len(kinds)].take(b, 1) - self.kinds[: len(kinds)].take(a, 1), kinds[:, None]).sum(0, dtype=np.int32)


def _in_both(room: np.ndarray, own: list[int], frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many letters of the first kinds, and of all, both windows (kinds x windows) and a phrase have, in bytes."""
    total, some, rest = np.zeros(room.shape[1], np.uint8), np.empty(room.shape[1], np.uint8), None
    for kind, n in enumerate(own):
        if kind == frequent:
            rest = total.copy()
        if n:
            np.minimum(room[kind], np.uint8(min(n, 255)), out=some)
            total += some
    return rest, total


def _running(counts: np.ndarray, rows: int, kind: type) -> np.ndarray:
    """Rows of running numbers, from zero on, of a row of counts."""
    counts = counts.reshape(rows, -1)
    out = np.zeros((rows, counts.shape[1] + 1), kind)
    np.cumsum(counts, axis=1, dtype=kind, out=out[:, 1:])
    return out


# -- rungs: a phrase stands in a text in one form or another -------------------------------


def composed(text: str) -> str:
    """NFKC without blanks around."""
    return unicodedata.normalize("NFKC", text).strip()


def letters(text: str) -> str:
    """Letters and digits of a folded text, whatever else lies between them being one blank."""
    return re.sub(r"[\W_]+", " ", text.casefold()).strip()


# Names and scores of the rungs, from the strictest on, and the least ratio of the last.
RUNGS = (("unicode_normalized_exact", 1.0), ("case_insensitive", 0.98), ("punctuation_insensitive", 0.95))
FUZZY_RUNG = "token_fuzzy_fallback"
FUZZY_LEAST = 0.6
#: Texts and letters that are held against phrases at once.
TEXTS, AT_ONCE = 512, 1 << 17


def forms(text: str) -> tuple[str, ...]:
    """A text in the form that each rung compares; what contains another in one form does so in all later ones, if that one has letters."""
    own = composed(text)
    return own, own.casefold(), letters(own)


def rung(phrase: tuple[str, ...], text: tuple[str, ...]) -> tuple[str, float] | None:
    """The strictest rung on which the text's form has the phrase's. A phrase without letters has no form on the last one."""
    for k, (name_score, p, t) in enumerate(zip(RUNGS, phrase, text, strict=True)):
        if (p or k + 1 < len(RUNGS)) and p in t:
            return name_score
    return None


class Alike:
    """Phrases, by the form of the last rung, to be held as a whole against whole texts by the sequence matcher.

    A pair is matched letter by letter only if no bound rules out that M letters match, the fewest that make the least ratio. M is at most the
    number of letters that both have, whatever their order. Of texts with fewer than ``POPULAR_FROM`` letters the matcher takes the longest common
    block, first in phrase and text, and goes on to the left and the right of it; so do the bounds, by common runs of four letters and then
    of two, all pairs side by side, and what is left to either side of the blocks holds at most the letters that both have there. In longer texts a block
    has a letter that isn't popular, but for one at the very start, so there are at most B + 1 of them, where B such letters are common, and all but three letters of each begin four that stand in the phrase.
    """

    def __init__(self, phrases: list[str]):
        self.text = phrases
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.longest = int(max(self.size, default=0) * (2 / FUZZY_LEAST - 1)) + 1
        self.letters, n = np.unique(_points("".join(phrases)), return_counts=True)
        self.kind = np.full(len(n) + 1, KINDS)  # the last letter is any other
        self.kind[np.argsort(-n, kind="stable")] = np.arange(len(n)) % KINDS
        codes = self._codes(phrases)
        two = self._two(codes)
        self.twos = np.unique(two[two >= 0])
        four = self._four(_place(self.twos, two))
        self.fours = np.unique(four[four >= 0])
        four, start = _place(self.fours, four), np.cumsum(self.size + 1) - self.size - 1
        self.sides = [self._side(codes, four, start, at) for at in range(0, len(phrases), SIDE_BY_SIDE)]

    def _codes(self, texts: list[str]) -> np.ndarray:
        """Places of the letters, with any other letter after each text."""
        c = _points("".join(t + "\0" for t in texts))
        return np.where((at := _place(self.letters, c)) < 0, len(self.letters), at)

    def _two(self, codes: np.ndarray) -> np.ndarray:
        """For each letter the number of it and the next; -1 if one of them is none of the phrases'."""
        n, then = len(self.letters), np.append(codes[1:], len(self.letters))
        return np.where((codes < n) & (then < n), codes * n + then, -1)

    def _four(self, two: np.ndarray) -> np.ndarray:
        then = np.append(two[2:], [-1, -1])[: len(two)]
        return np.where((two >= 0) & (then >= 0), two * len(self.twos) + then, -1)

    def _side(self, codes: np.ndarray, four: np.ndarray, start: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        """Of some phrases: letters of each kind; runs of four in order, the phrases that have each as bits; and where it begins in a list of phrases and places in them."""
        size = self.size[at : at + SIDE_BY_SIDE]
        own = slice(int(start[at]), int(start[at] + (size + 1).sum()))
        whose = np.repeat(np.arange(len(size)), size + 1)
        kinds = np.bincount(whose * (KINDS + 1) + self.kind[codes[own]], minlength=len(size) * (KINDS + 1)).reshape(-1, KINDS + 1)[:, :KINDS]
        place = np.arange(len(whose)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        order = np.argsort(four[own], kind="stable")
        order = order[np.searchsorted(four[own][order], 0) :]
        gram, first = np.unique(four[own][order], return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << whose[order].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        return kinds.astype(np.int32), gram, bits, np.append(first, len(order)), whose[order].astype(np.uint8), place[order].astype(np.int32)

    def search(self, texts: list[str], passed: list[Collection[int]]) -> list[tuple[int, int, float]]:
        """(place of the text, place of the phrase, ratio) of the pairs that reach ``FUZZY_LEAST``, but for the phrases that are ``passed`` over for a text."""
        some = [n for n, t in enumerate(texts) if len(t) <= self.longest]
        if not some or not self.text:
            return []
        length = np.array([len(texts[n]) for n in some], np.int64)
        codes = self._codes([texts[n] for n in some])
        four = _place(self.fours, self._four(_place(self.twos, self._two(codes))))
        whose = np.repeat(np.arange(len(some)), length + 1)
        each, n = np.unique(whose * (len(self.letters) + 1) + codes, return_counts=True)
        of, kind = each // (len(self.letters) + 1), self.kind[each % (len(self.letters) + 1)]
        kinds, rare = np.zeros((2, len(some), KINDS + 1), np.int32)
        np.add.at(kinds, (of, kind), n)
        np.add.at(rare, (of, kind), np.where(n > length[of] // 100 + 1, 0, n))
        out = []
        for at in range(0, len(self.text), SIDE_BY_SIDE):
            side, size = self.sides[at // SIDE_BY_SIDE], self.size[at : at + SIDE_BY_SIDE]
            need = np.ceil((size[None] + length[:, None]) * (FUZZY_LEAST / 2) - 1e-6).astype(np.int64)
            could = need <= np.minimum(size[None], length[:, None])
            for r, n in enumerate(some):
                if gone := [k - at for k in passed[n] if at <= k < at + len(size)]:
                    could[r, gone] = False
            if not could.any():
                continue
            could &= np.minimum(kinds[:, None, :KINDS], side[0][None]).sum(2) >= need
            long = length >= POPULAR_FROM
            if could[long].any():
                blocks = np.minimum(rare[:, None, :KINDS], side[0][None]).sum(2) + 1
                could &= ~long[:, None] | (self._standing(side, four, whose, could.shape) + 3 * blocks >= need)
            t, p = np.nonzero(could & ~long[:, None])
            if len(t):
                could[t, p] = self._greedy(side, at, codes, four, whose, np.cumsum(length + 1) - length - 1, length, t, p, need[t, p])
            for r, k in zip(*np.nonzero(could), strict=True):
                ratio = SequenceMatcher(None, self.text[at + k], texts[some[r]]).ratio()
                if ratio >= FUZZY_LEAST:
                    out.append((some[r], int(at + k), round(ratio, 6)))
        return out

    def _standing(self, side: tuple[np.ndarray, ...], four: np.ndarray, whose: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Texts x phrases: the places of a text where four letters begin that stand in a phrase."""
        _, gram, bits, *_ = side
        out = np.zeros(shape, np.int64)
        at = _place(gram, four)
        hits = np.flatnonzero(at >= 0)
        for lo in range(0, len(hits), LETTERS):
            own = hits[lo : lo + LETTERS]
            one = np.unpackbits(bits[at[own]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : shape[1]]
            first = np.flatnonzero(np.diff(whose[own], prepend=-1))
            out[whose[own[first]]] += np.add.reduceat(one, first, axis=0, dtype=np.int64)
        return out

    def _greedy(self, side, at, codes, four, whose, start, length, t, p, need) -> np.ndarray:  # noqa: ANN001
        """Of pairs of short texts ``t`` and phrases ``p`` (both in order), which could have ``need`` matching letters."""
        _, gram, _, first, phrase, place = side
        here = _place(gram, four)
        hits = np.flatnonzero((here >= 0) & (length < POPULAR_FROM)[whose])
        n = first[here[hits] + 1] - first[here[hits]]
        work = np.bincount(whose[hits], n, minlength=len(length))
        out = np.zeros(len(t), bool)
        lo = 0
        while lo < len(t):  # as many texts as give so many common runs
            upto = int(np.searchsorted(np.cumsum(work[t[lo] :]), SHARED, "right")) + t[lo]
            hi = int(np.searchsorted(t, max(upto, t[lo] + 1)))
            a, b = np.searchsorted(whose[hits], [t[lo], t[hi - 1] + 1])
            own, m = hits[a:b], n[a:b]
            entry = np.arange(m.sum()) + np.repeat(first[here[own]] - (np.cumsum(m) - m), m)
            number = np.full((t[hi - 1] + 1 - t[lo], SIDE_BY_SIDE), -1)
            number[t[lo:hi] - t[lo], p[lo:hi]] = np.arange(hi - lo)
            pair = number[np.repeat(whose[own], m) - t[lo], phrase[entry]]
            asked = pair >= 0
            pair, i, j = pair[asked], place[entry[asked]].astype(np.int64), np.repeat(own - start[whose[own]], m)[asked]
            g = _Greedy(self, at, codes, start, length, t[lo:hi], p[lo:hi], need[lo:hi])
            out[lo:hi] = g.could(pair, i, j)
            lo = hi
        return out


class _Greedy:
    """Pairs of phrases and short texts: blocks as the sequence matcher takes them, and ranges that are open between them."""

    def __init__(self, phrases: Alike, at: int, codes: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray, p: np.ndarray, need: np.ndarray):
        self.need, self.done, self.live = need, np.zeros(len(t), np.int64), np.ones(len(t), bool)
        texts, self.t = np.unique(t, return_inverse=True)
        own, self.p = np.unique(p, return_inverse=True)
        long = [phrases.text[at + k] for k in own]
        self.others = len(phrases.letters)
        self.a = self._dealt(phrases._codes(long), np.array([len(x) for x in long]))
        some = np.concatenate([np.arange(start[k], start[k] + length[k] + 1) for k in texts])
        self.b = self._dealt(codes[some], length[texts])
        self.kinds_a, self.kinds_b = self._running(phrases.kind[self.a]), self._running(phrases.kind[self.b])
        self.size, self.length = np.array([len(x) for x in long])[self.p], length[t]

    @staticmethod
    def _dealt(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row for each of some texts that lie one after another with one value between; -1 beyond its end."""
        out = np.full((len(size), int(size.max()) + 1), -1)
        inside = np.arange(out.shape[1])[None] < size[:, None] + 1
        out[inside] = flat
        out[np.arange(len(size)), size] = -1
        return out

    @staticmethod
    def _running(kind: np.ndarray) -> np.ndarray:
        """Texts x places x kinds: letters before the place."""
        one = np.zeros((*kind.shape, KINDS + 1), np.uint16)
        np.put_along_axis(one[:, 1:], kind[:, :-1, None], 1, 2)
        return np.cumsum(one, axis=1, dtype=np.uint16)[:, :, :KINDS]

    def _room(self, pair: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Letters that both have in ranges of phrase and text."""
        p, t = self.p[pair], self.t[pair]
        return np.minimum(self.kinds_a[p, a1] - self.kinds_a[p, a0], self.kinds_b[t, b1] - self.kinds_b[t, b0]).sum(1, dtype=np.int64)

    def could(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs could reach what they need; common runs of four letters stand at ``i`` of the phrase and ``j`` of the text."""
        every, none = np.arange(len(self.t)), np.zeros(len(self.t), np.int64)
        open_ = self._blocks(4, np.stack([every, none, self.size, none, self.length]), pair, i, j)
        for k in (3, 2):
            if not open_.shape[1]:
                break
            open_ = self._finer(k, open_[:, np.argsort(open_[0], kind="stable")])
        return self.live

    def _runs(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The number of each run of ``k`` letters, -1 where one of them is none of the phrases'."""
        n = self.others
        out, fine = codes[:, : codes.shape[1] - k + 1].copy(), np.ones((len(codes), max(0, codes.shape[1] - k + 1)), bool)
        for s in range(k):
            then = codes[:, s : s + out.shape[1]]
            fine &= (then >= 0) & (then < n)
            out = out * n + then if s else out
        return np.where(fine, out, -1)

    def _finer(self, k: int, open_: np.ndarray) -> np.ndarray:
        """``_blocks`` of ranges in order of their pairs, by common runs of ``k`` letters."""
        a, b = self._runs(self.a, k), self._runs(self.b, k)
        p, at = np.nonzero(a >= 0)
        known, rank = np.unique(a[p, at], return_inverse=True)
        key = p * len(known) + rank
        first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(self.a) * len(known)))])
        place, b = at[np.argsort(key, kind="stable")], _place(known, b.ravel()).reshape(b.shape)
        pair, a0, a1, b0, b1 = open_
        wide = np.maximum(b1 - b0 - k + 1, 0)
        own = np.repeat(np.arange(len(pair)), wide)
        j = np.arange(len(own)) + np.repeat(b0 - (np.cumsum(wide) - wide), wide)
        gram = b[self.t[pair[own]], j]
        own, j, gram = (x[gram >= 0] for x in (own, j, gram))
        key = self.p[pair[own]] * len(known) + gram
        n = first[key + 1] - first[key]
        ends = np.cumsum(np.bincount(own, n, minlength=len(pair)).astype(np.int64))
        left, lo = [open_[:, :0]], 0
        while lo < len(pair):  # whole pairs, as many as give so many common runs
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARED, "right")), lo + 1)
            hi = int(np.searchsorted(pair, pair[hi - 1], "right"))
            some = slice(*np.searchsorted(own, [lo, hi]))
            m = n[some]
            entry = np.arange(m.sum()) + np.repeat(first[key[some]] - (np.cumsum(m) - m), m)
            i, whose = place[entry], np.repeat(own[some], m)
            inside = (i >= a0[whose]) & (i + k <= a1[whose])
            left.append(self._blocks(k, open_[:, lo:hi], whose[inside] - lo, i[inside], np.repeat(j[some], m)[inside]))
            lo = hi
        return np.concatenate(left, axis=1)

    def _blocks(self, k: int, open_: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Takes the blocks of at least ``k`` letters in open ranges (pair, from and to in the phrase and in the text), whose common runs of ``k`` (range, places) are given.

        Gives the ranges that have no such run, of the pairs that live on.
        """
        order = np.argsort((own << 24) + (j - i + (1 << 11) << 12) + j, kind="stable")
        own, i, j = own[order], i[order], j[order]
        closed, rest, asked = [open_[:, :0]], np.zeros(len(self.need), np.int64), np.unique(open_[0])
        while open_.shape[1]:
            room = self._room(*open_)
            most = self.done + rest + np.bincount(open_[0], room, minlength=len(rest)).astype(np.int64)
            self.live[asked] &= (most >= self.need)[asked]
            runs = np.zeros(open_.shape[1], bool)
            runs[own] = True
            end = ~runs & self.live[open_[0]]
            rest += np.bincount(open_[0][end], room[end], minlength=len(rest)).astype(np.int64)
            closed.append(open_[:, end & (room > 0)])
            on = runs & self.live[open_[0]]
            kept, renamed = on[own], np.cumsum(on) - 1
            open_, own, i, j = open_[:, on], renamed[own[kept]], i[kept], j[kept]
            if not len(own):
                break
            first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(i, prepend=-2) != 1) | (np.diff(j, prepend=-2) != 1))
            long = np.diff(np.append(first, len(own)))
            best = np.maximum.reduceat((long << 24) - (i[first] << 12) - j[first], np.flatnonzero(np.diff(own[first], prepend=-1)))
            size = -(-best >> 24)
            left = (size << 24) - best
            x, y, size = left >> 12, left & 4095, size + k - 1
            np.add.at(self.done, open_[0], size)
            before = (i + k <= x[own]) & (j + k <= y[own])
            after = (i >= (x + size)[own]) & (j >= (y + size)[own])
            pair, a0, a1, b0, b1 = open_
            own, i, j = (np.concatenate([v[before], w[after]]) for v, w in ((own, own + len(pair)), (i, i), (j, j)))
            open_ = np.concatenate([np.stack([pair, a0, x, b0, y]), np.stack([pair, x + size, a1, y + size, b1])], axis=1)
        left = np.concatenate(closed, axis=1)
        return left[:, self.live[left[0]]]


class Automaton:
    """Finds all phrases that a text contains in one pass over its letters."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.forms = [forms(p) for p in phrases]
        self.bare = [k for k, f in enumerate(self.forms) if not f[-1]]  # no letters: looked for one by one
        self.found = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for k, f in enumerate(self.forms):
            if f[-1]:
                same.setdefault(f[-1], []).append(k)
        for p, ks in same.items():
            self.found.add_word(p, ks)
        self.empty = not same
        if same:
            self.found.make_automaton()

    def search(self, text: str) -> dict[int, tuple[str, float]]:
        """Place of each phrase that stands in the text, with its rung."""
        return self.standing(forms(text))

    def standing(self, own: tuple[str, ...]) -> dict[int, tuple[str, float]]:
        """``search`` by a text's forms."""
        near = set(self.bare)
        if not self.empty:
            for _, ks in self.found.iter(own[-1]):
                near.update(ks)
        return {k: r for k in sorted(near) if (r := rung(self.forms[k], own))}


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())
