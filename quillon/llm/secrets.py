"""Secret scans: base patterns and a linear-chain conditional random field.

Tokens are runs without blanks. The field tags each as secret begin (B), inside (I) or
outside (O) from its own shape, its neighbours' shapes and key words, and features of the
whole file; Viterbi finds the best tags. Its weights maximise the conditional log-likelihood of the tags, with
gradients by forward-backward sums, on lines made from a rule by
which values of several kinds stand in ordinary prose, code and settings, next to look-alikes that aren't secret.

Decoding is exact but needs few tokens: where O leads both other tags by more than all
transitions can make up, the best path passes through O. Such tokens cut the chain, and
Viterbi runs over the short pieces between them only.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import appended, byte_views, row_sums

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is a whole run: it starts where a run starts
KINDS = ("assign", "access", "hex")
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

# Words that announce a secret.
KEYS = frozenset(
    "password passwd pwd passphrase secret secrets token apikey api_key api-key access_key secret_key private_key "
    "credential credentials auth authorization bearer key client_secret aws_secret_access_key".split()
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """kind, start, end of the whole match, in code points, by start and then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- features: a token is a bit set, weights give its scores ------------------------

FLAGS = (
    "key link assigns keyvalue quoted n8 n12 n20 n32 digit mixed cases alternates prefix symbols hexlike uuid number dated email url userinfo path pem upper plain"
).split()
_BIT = {n: 1 << i for i, n in enumerate(FLAGS)}
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>=*#$%&|"
#: Words between a key word and its value.
LINKS = ("is", "was", "use", "using", "=", ":", ":=", "=>", "->")
_KEY_HEAD = r"(?i)^[\"'({\[]*(?:[\w.-]*[_.-])?(?:" + "|".join(sorted(map(re.escape, KEYS), key=len, reverse=True)) + r")[\"']?(?:[:=]+>?|->)[\"']?"
_SHAPES = {
    "keyvalue": _KEY_HEAD + r"[^\s\"':=]{6,}",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "number": r"^[-+]?[0-9][0-9.,:x%-]*$",
    "dated": r"^[0-9]{1,4}[-/.:T][0-9]{1,2}[-/.:]",
    "email": r"^[^@:/]+@[^@:/]+\.[A-Za-z]+$",
    "url": r"^[a-z][a-z0-9+.-]*://|^www\.",
    "userinfo": r"://[^\s:/@]*:[^\s@/]{3,}@",
    "path": r"/[^/]*/|\\[^\\]*\\|^[\w-]+(?:/[\w.-]+)+$|\.[a-z]{2,4}$",
    "prefix": r"^[A-Za-z]{2,6}(?:[_-][A-Za-z]{2,6})?[_-][A-Za-z0-9][A-Za-z0-9_-]{10,}$|^eyJ[\w-]{8,}\.",
    "pem": r"^-----|-----$",
}
_VALUE = re.compile(_KEY_HEAD.encode() + rb"(.+)$", re.S)
_USERINFO = re.compile(rb"://[^\s:/@]*:([^\s@/]+)@")

# byte classes: 1 digit, 2 capital, 4 lower-case letter, 8 other, and 16 for the digits and letters of hexadecimal
_CLASS = np.full(256, 8, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = (1 if _c.isdigit() else 2 if _c.isupper() else 4 if _c.islower() else 8) | (16 if _c in "0123456789abcdefABCDEF" else 0)
_CLASS[128:] = 4


def flags(tokens: pa.Array) -> np.ndarray:
    """The shapes of tokens, each a set of bits; the edge marks around a token don't count."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    core = pc.ascii_trim(tokens, characters=_EDGE)
    low = pc.ascii_lower(core)
    raw, off = byte_views(core)
    kind = _CLASS[raw]
    n = np.diff(off)
    digits, upper, lower, symbol, hexes = (row_sums((kind & c) > 0, off) for c in (1, 2, 4, 8, 16))
    turns = np.zeros(len(raw), bool)
    turns[1:] = ((kind[1:] & 1) != (kind[:-1] & 1)) & ((kind[1:] & 8) == 0) & ((kind[:-1] & 8) == 0)
    turns[off[:-1][n > 0]] = False
    changes = row_sums(turns, off)
    f = np.zeros(len(tokens), np.int64)

    def put(name: str, mask: np.ndarray) -> None:
        f[mask] |= _BIT[name]

    for size in (8, 12, 20, 32):
        put(f"n{size}", n >= size)
    put("digit", digits > 0)
    put("mixed", (digits > 0) & (upper + lower > 0))
    put("cases", (upper >= 2) & (lower >= 2))
    put("alternates", changes >= 3)
    put("symbols", symbol > 0)
    put("hexlike", (n >= 8) & (hexes == n))
    put("upper", (upper >= 2) & (lower + digits == 0))
    own, at = byte_views(tokens)
    last, first = own[at[1:] - 1], own[at[:-1]]
    put("assigns", np.isin(last, [58, 61]))
    put("quoted", np.isin(first, [34, 39, 96]) & (np.diff(at) > 2))
    put("key", pc.is_in(low, pa.array(sorted(KEYS), low.type)).to_numpy(zero_copy_only=False))
    put("link", pc.is_in(pc.ascii_lower(tokens), pa.array(LINKS, tokens.type)).to_numpy(zero_copy_only=False))
    put("plain", (n > 0) & (digits + symbol == 0) & (n < 20))
    # only what has digits, marks or length can have one of the shapes
    odd = np.flatnonzero((digits + symbol > 0) | (n >= 20) | (first == 45) | (last == 45))
    if len(odd):
        of_core, of_all = core.take(pa.array(odd)), tokens.take(pa.array(odd))
        for name, shape in _SHAPES.items():
            hit = pc.match_substring_regex(of_all if name in ("pem", "keyvalue") else of_core, shape)
            put(name, odd[hit.to_numpy(zero_copy_only=False)])
    return f


STATES = 3  # O, B, I
FILE = ("many_keys", "assignments", "long_tokens")
#: Neighbours whose shapes count: places before (negative) and after.
AROUND = (0, -1, -2, 1)
NEVER = -1e9


def file_flags(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of whole files, from their tokens' flags: a row of 0 and 1 for each file."""
    n = np.maximum(1, np.diff(off))
    keys, sets, long = (row_sums((flag & _BIT[k]) != 0, off) for k in ("key", "assigns", "n20"))
    return np.column_stack([keys >= 3, 20 * sets >= n, 50 * long >= n]).astype(np.int64)


def bits(flag: np.ndarray) -> np.ndarray:
    return (flag[:, None] >> np.arange(len(FLAGS))) & 1


@dataclass
class Field:
    """Weights: shape[place around, flag, state], file[feature, state], bias[state], step[from, to]; a line starts as if after O."""

    shape: np.ndarray
    file: np.ndarray
    bias: np.ndarray
    step: np.ndarray

    @staticmethod
    def zero() -> Field:
        step = np.zeros((STATES, STATES))
        step[0, 2] = NEVER  # O may not go to I
        return Field(np.zeros((len(AROUND), len(FLAGS), STATES)), np.zeros((len(FILE), STATES)), np.zeros(STATES), step)

    def emissions(self, flag: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Scores of all tokens' tags; ``off`` parts the files, whose tokens are no neighbours."""
        seen, which = np.unique(flag, return_inverse=True)  # few shapes, many tokens
        tables = [bits(seen) @ w for w in self.shape]
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        e = self.bias + (file_flags(flag, off) @ self.file)[row]
        for k, table in zip(AROUND, tables, strict=True):
            if k == 0:
                e += table[which]
            elif k < 0:
                e[-k:] += np.where((row[-k:] == row[:k])[:, None], table[which[:k]], 0)
            else:
                e[:-k] += np.where((row[k:] == row[:-k])[:, None], table[which[k:]], 0)
        return e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one chain; it starts as if after O."""
        n, step = len(e), self.step
        back = np.zeros((n, STATES), np.int8)
        score = step[0] + e[0]
        for i in range(1, n):
            to = score[:, None] + step
            back[i] = to.argmax(0)
            score = to.max(0) + e[i]
        tags = np.zeros(n, np.int8)
        tags[-1] = score.argmax()
        for i in range(n - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags

    def log_partition(self, e: np.ndarray) -> float:
        """Logarithm of the sum over all tag sequences of the exponential of their scores."""
        a = self.step[0] + e[0]
        for x in e[1:]:
            a = np.logaddexp.reduce(a[:, None] + self.step, axis=0) + x
        return float(np.logaddexp.reduce(a))

    def seeds(self, e: np.ndarray) -> np.ndarray:
        """Tokens that alone can make B or I pay.

        Against all O, a stretch of B and I gains at most the sum over its tokens of what B or I
        leads O by, plus the best step into B or I less the step from O to O. So without a token
        where that is positive the best path is O throughout, given that leaving the stretch
        gains nothing either (else that gain is added as well).
        """
        stay = self.step[0, 0]
        leave = max(0.0, self.step[1:, 0].max() - stay)
        return np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + self.step[:, 1:].max() - stay + leave > 0

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The same tags as ``viterbi``, less work: pieces between tokens that are O beyond doubt, if they have a seed."""
        tags = np.zeros(len(e), np.int8)
        seeds = self.seeds(e)
        if not seeds.any():
            return tags
        # a tag made O changes two steps; where an I follows, it must become B, which changes a third and its own score
        finite = self.step[self.step > NEVER / 2]
        follows = np.append(np.maximum(0, e[1:, 2] - e[1:, 1]), 0)
        doubt = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= 3 * (finite.max() - finite.min()) + follows
        edge = np.flatnonzero(np.diff(np.concatenate([[0], doubt.view(np.int8), [0]])))
        done = -1
        for i in np.flatnonzero(seeds).tolist():
            if i <= done:
                continue
            k = np.searchsorted(edge, i, side="right")
            a, b = int(edge[k - 1]), int(edge[k])
            stop = min(len(e), b + 1)  # with the sure O after it, whose step counts
            tags[a:b] = self.viterbi(e[a:stop])[: b - a]
            done = b - 1
        return tags


# -- training ----------------------------------------------------------------------

_LOW, _ALNUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _some(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def _word(rng: random.Random, least: int = 1, most: int = 12) -> str:
    w = _some(rng, _LOW, rng.randint(least, most))
    return w.capitalize() if rng.random() < 0.1 else w


def _value(rng: random.Random) -> str:
    """A random value or a made password."""
    kind, size = rng.random(), rng.choice([16, 20, 24, 32, 40, 64])
    if kind < 0.2:
        return _some(rng, rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), size)
    if kind < 0.5:
        return _some(rng, _ALNUM + rng.choice(["", "+/", "_-"]), size)
    if kind < 0.65:
        return _some(rng, _LOW, rng.randint(2, 5)) + rng.choice("_-") + _some(rng, _ALNUM, size)
    joint = rng.choice(["", "", "-", "_", "!", "@", "."])
    return _word(rng, 3, 8) + joint + str(rng.randint(1, 9999)) + rng.choice(["", _word(rng, 3, 6), rng.choice("!#?*")])


def _look_alike(rng: random.Random) -> list[str]:
    """What isn't secret: addresses, paths, numbers, dates, ids, commits, identifiers, plain words after key words."""
    hexes = "0123456789abcdef"
    kind = rng.randint(0, 12)
    if kind == 0:
        return [f"{_word(rng)}.{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com"]
    if kind == 1:
        return ["https://example.com/" + "/".join(_word(rng) for _ in range(3)) + rng.choice(["", f"?id={rng.randint(1, 99999)}", f"-{_some(rng, hexes, 12)}"])]
    if kind == 2:
        return [str(rng.randint(0, 10 ** rng.randint(1, 20)))]
    if kind == 3:
        return [f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", f"T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z"])]
    if kind == 4:
        return [rng.choice(["commit", "revision", "at", "sha", ""]), _some(rng, hexes, rng.choice([7, 8, 12, 20]))][rng.randint(0, 1) :]
    if kind == 5:
        return ["-".join(_some(rng, hexes, n) for n in (8, 4, 4, 4, 12))]
    if kind == 6:
        return [rng.choice(["/", "./", "src/", "C:\\"]) + "/".join(_word(rng) for _ in range(3)) + rng.choice([".py", ".txt", "", "_v2.json"])]
    if kind == 7:
        return [rng.choice(["get", "set", "make", "Read"]) + "".join(_word(rng, 3, 8).capitalize() for _ in range(3)) + rng.choice(["", "2", "()"])]
    if kind == 8:
        return ["_".join(_word(rng, 2, 8).lower() for _ in range(rng.randint(2, 4))) + rng.choice(["", f"_{rng.randint(0, 99)}"])]
    if kind == 9:
        return [_word(rng).lower() + rng.choice("-_") + str(rng.randint(1, 99999))]
    if kind == 10:
        return [rng.choice(sorted(KEYS)), rng.choice(["=", ":", "of", "is", "was", "and", "for"]), _word(rng, 2, 12)]
    if kind == 11:
        return [rng.choice(["the", "my", "a"]), rng.choice(sorted(KEYS)) + rng.choice(["", ",", ".", ":"]), _word(rng), _word(rng)]
    return [_some(rng, _LOW, rng.randint(13, 40))]


def _secret(rng: random.Random) -> tuple[list[str], list[int]]:
    """One secret in its setting, and its tags."""
    v, key, kind = _value(rng), rng.choice(sorted(KEYS)), rng.random()
    quote = rng.choice(['"', "'", "", ""])
    q = quote + v + quote + rng.choice(["", "", "", ",", ";"])
    if kind < 0.2:
        return [key, rng.choice(["=", ":", ":=", "=>"]), q], [0, 0, 1]
    if kind < 0.33:
        return [key + rng.choice([":", "="]), q], [0, 1]
    if kind < 0.44:
        return [rng.choice(["", _word(rng, 2, 6).lower() + "_"]) + key + rng.choice(["=", ":"]) + q], [1]
    if kind < 0.58:
        return [key, q], [0, 1]
    if kind < 0.7:
        return [key, rng.choice(["is", "was"]), q], [0, 0, 1]
    if kind < 0.79:
        return [f"{rng.choice(['postgres', 'https', 'ftp', 'redis'])}://{_word(rng, 3, 8).lower()}:{v}@{_word(rng, 3, 8).lower()}.example.com/{_word(rng)}"], [1]
    if kind < 0.89:
        long = _some(rng, _LOW, rng.randint(2, 5)) + rng.choice(["_", "-"]) + _some(rng, _ALNUM, rng.choice([24, 32, 36, 40]))
        return [*rng.choice([[], [], ["use"], ["Bearer"]]), long], []
    body = [_some(rng, _ALNUM + "+/", 64) for _ in range(rng.randint(1, 6))]
    name = rng.choice([["RSA", "PRIVATE"], ["PRIVATE"], ["DSA", "PRIVATE"]])
    tokens = ["-----BEGIN", *name, "KEY-----", *body, "-----END", *name, "KEY-----"]
    return tokens, [1] + [2] * (len(tokens) - 1)


def training_lines(n: int, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Made lines of tokens and tags: secrets of several kinds in prose, code and settings, and look-alikes that aren't secret."""
    rng, lines = random.Random(seed), []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[int] = []
        shout = rng.random() < 0.1  # whole lines of capitals
        for _ in range(rng.randint(2, 12)):
            r = rng.random()
            if r < 0.08:
                made, tag = _secret(rng)
                tag = tag or [0] * (len(made) - 1) + [1]
            elif r < 0.3:
                made = _look_alike(rng)
                tag = [0] * len(made)
            else:
                made, tag = [_word(rng) + rng.choice(["", "", "", "", ",", ".", "***", "###", "!!"])], [0]
                made = [w.upper() for w in made] if shout else made
            tokens += made
            tags += tag
        lines.append((tokens, tags))
    return lines


class Lines:
    """Lines as padded arrays, for likelihoods of all at once."""

    def __init__(self, lines: list[tuple[list[str], list[int]]]):
        sizes = np.array([len(t) for t, _ in lines])
        off = np.concatenate([[0], sizes.cumsum()])
        flag = flags(pa.array([t for tokens, _ in lines for t in tokens]))
        own = bits(flag)
        row = np.repeat(np.arange(len(lines)), sizes)
        parts = []
        for k in AROUND:
            x = np.zeros_like(own)
            if k == 0:
                x = own
            elif k < 0:
                x[-k:] = np.where((row[-k:] == row[:k])[:, None], own[:k], 0)
            else:
                x[:-k] = np.where((row[k:] == row[:-k])[:, None], own[k:], 0)
            parts.append(x)
        # many tokens look alike: scores and gradients go by distinct rows
        wide = np.column_stack([*parts, file_flags(flag, off)[row], np.ones(len(row), int)])
        self.x, self.which = np.unique(wide, axis=0, return_inverse=True)
        self.x = self.x.astype(float)
        self.place = (row, np.arange(len(row)) - off[row])
        self.mask = np.arange(sizes.max())[None, :] < sizes[:, None]
        self.tags = np.zeros(self.mask.shape, int)
        self.tags[self.place] = np.concatenate([t for _, t in lines])

    def value(self, w: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of all tags and its gradients in ``w`` (features x states) and ``step``, by forward-backward sums."""
        n, t = self.mask.shape
        e = np.zeros((n, t, STATES))
        e[self.place] = (self.x @ w)[self.which]
        top = e.max(2, keepdims=True)
        own, step_ = np.exp(e - top), np.exp(step)
        # sums over all beginnings and endings, each scaled to 1; past its end a line keeps its last sums
        alpha, beta, scale = np.zeros((n, t, STATES)), np.ones((n, t, STATES)), np.ones((n, t))
        for i in range(t):
            new = (alpha[:, i - 1] @ step_ if i else step_[0]) * own[:, i]
            c = new.sum(1)
            go = self.mask[:, i]
            alpha[:, i] = np.where(go[:, None], new / c[:, None], alpha[:, i - 1])
            scale[:, i] = np.where(go, c, 1.0)
        for i in range(t - 1, 0, -1):
            new = (own[:, i] * beta[:, i]) @ step_.T / scale[:, i, None]
            beta[:, i - 1] = np.where(self.mask[:, i, None], new, 1.0)
        z = (np.log(scale) + top[:, :, 0] * self.mask).sum()
        p = alpha * beta * self.mask[:, :, None]
        after = own[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * self.mask[:, 1:, None]
        both = np.tensordot(alpha[:, :-1], after, axes=([0, 1], [0, 1])) * step_
        right = np.eye(STATES)[self.tags] * self.mask[:, :, None]
        last = np.concatenate([np.zeros((n, 1), int), self.tags[:, :-1]], 1)
        score = (right * e).sum() + (step[last, self.tags] * self.mask).sum()
        off = (right - p)[self.place]
        by_row = np.column_stack([np.bincount(self.which.ravel(), off[:, k], len(self.x)) for k in range(STATES)])
        g = np.zeros((STATES, STATES))
        np.add.at(g, (last[self.mask], self.tags[self.mask]), 1.0)
        g -= both
        g[0] -= p[:, 0].sum(0)
        return float(score - z), self.x.T @ by_row, g


@cache
def trained(lines: int = 2_500, rounds: int = 150, seed: int = 7, l2: float = 0.3) -> Field:
    """The field of the largest penalised conditional likelihood, by gradient ascent with adaptive steps.

    The bound on the made lines is ``lines``; no corpus row is read.
    """
    # short lines only: they are padded to the longest
    data, f = Lines([x for x in training_lines(lines, seed) if len(x[0]) <= 32]), Field.zero()
    w, step = np.zeros((data.x.shape[1], STATES)), f.step.copy()
    fixed = step < NEVER / 2
    mean = [np.zeros_like(w), np.zeros_like(step)]
    power = [np.zeros_like(w), np.zeros_like(step)]
    for k in range(1, rounds + 1):
        _, gw, gs = data.value(w, step)
        grads = [gw - l2 * w, np.where(fixed, 0.0, gs - l2 * np.where(fixed, 0, step))]
        rate = 0.25 * (1 - 0.9 * k / rounds)
        for x, g, m, v in zip((w, step), grads, mean, power, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    size = len(AROUND) * len(FLAGS)
    return Field(w[:size].reshape(len(AROUND), len(FLAGS), STATES), w[size : size + len(FILE)], w[-1], np.where(fixed, NEVER, step))


# -- whole texts -----------------------------------------------------------------


def value_part(core: bytes) -> tuple[int, int]:
    """Where in a tagged token its value is: the password of an address, what follows a key word, else all; without edge marks."""
    a, b = 0, len(core)
    if m := _USERINFO.search(core):
        return m.span(1)
    if m := _VALUE.match(core):
        a, b = m.span(1)
    edge = _EDGE.encode()
    own = core[a:b]
    return a + len(own) - len(own.lstrip(edge)), b - len(own) + len(own.rstrip(edge))


class Scanner:
    """Scans blocks of whole texts."""

    def __init__(self, field: Field):
        self.field = field

    def tagged(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """The place of each text with B or I tags, and its tags."""
        lists = pc.ascii_split_whitespace(texts)
        flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        off -= off[0]
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
        real = sizes[which] > 0 if len(which) else np.zeros(0, bool)
        off = np.concatenate([[0], real.cumsum()])[off]
        shape = np.zeros(len(sizes), np.int64)
        shape[sizes > 0] = flags(coded.dictionary.filter(pa.array(sizes > 0)))
        flag = shape[which[real]]
        if not len(flag):
            return
        e = self.field.emissions(flag, off)
        seeds = np.flatnonzero(self.field.seeds(e))
        for i in np.unique(np.searchsorted(off, seeds, side="right") - 1).tolist():
            tags = self.field.decode(e[off[i] : off[i + 1]])
            if tags.any():
                yield i, tags

    @staticmethod
    def spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
        """The tagged stretches as kind crf, in code points; those that touch no base span."""
        raw = text.encode()
        at = [m.span() for m in _TOKEN.finditer(raw)]
        found: list[list[int]] = []
        for i in np.flatnonzero(tags).tolist():
            a, b = at[i]
            if tags[i] == 2 and found and tags[i - 1]:
                found[-1][1] = b
                continue
            s, t = value_part(raw[a:b])
            if s < t:
                found.append([a + s, a + t])
        starts, ends = [s for _, s, _ in base], list(accumulate((t for _, _, t in base), max))
        out, place, bytes_ = [], 0, 0  # one running offset, whatever the number of spans
        for a, b in found:
            s = place + len(raw[bytes_:a].decode(errors="ignore"))
            t = s + len(raw[a:b].decode(errors="ignore"))
            place, bytes_ = t, b
            k = bisect_left(starts, t)
            if not k or ends[k - 1] <= s:
                out.append(("crf", s, t))
        return out

    def scan(self, texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text; nulls count as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        may = pc.match_substring_regex(texts, _ANY).to_pylist()
        base = [base_spans(texts[i].as_py()) if m else [] for i, m in enumerate(may)]
        out = [(b, b) for b in base]
        for i, tags in self.tagged(texts):
            more = self.spans(texts[i].as_py(), tags, base[i])
            out[i] = base[i], sorted([*base[i], *more], key=lambda s: (s[1], (*KINDS, "crf").index(s[0])))
        return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "<SECRET>") -> str:
    """The text with every span replaced; spans that overlap become one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str], redact: bool = False, prefix: str = "", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, n_assign, n_access, n_hex, n_crf, base, spans; with ``redact`` also redacted.

    ``base`` and ``spans`` are strings of kind:start:end. Null counts as empty and is redacted to null; repeated rows get
    equal results and an empty table none. The new names take ``prefix``, for tables that have columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    kinds = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("n_crf", "long"), ("base", "string"), ("spans", "string"), *[("redacted", "string")] * redact]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        scanner = Scanner(shared.value)

        def of(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for text, (base, spans) in zip(texts, scanner.scan(texts), strict=True):
                count = [sum(k == kind for k, _, _ in spans) for kind in (*KINDS, "crf")] if spans else [0] * 4
                own = (redacted(text.as_py(), spans) if text.is_valid else None,) if redact else ()
                rows.append((*count, joined(base), joined(spans), *own))
            types = [pa.int64()] * 4 + [pa.string()] * (3 if redact else 2)
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]

        return of

    return appended(docs, keep, text_col, make, [(prefix + n, t) for n, t in kinds])
