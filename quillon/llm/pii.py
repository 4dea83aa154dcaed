"""Personal data: base patterns, and a span classifier trained by weak supervision.

Base spans are fixed patterns and always stay. Further candidates come from wide patterns (written-out mail addresses,
phone numbers without a country code, addresses of version 6, account and insurance numbers, people's names, streets). Labelers
vote on each candidate: +1, -1 or nothing. They are of three sorts: regular expressions and checksums, gazetteers, and words
around. Spark counts how often each pattern of votes occurs in the whole corpus; expectation-maximisation on these
counts estimates how far each labeler can be trusted, and gives every pattern a probability. A logistic
classifier of spans learns these from the candidates' own features and decides; labels of documents are never read.

What the driver gathers is bounded: patterns of votes and features, at most ``PATTERNS`` of them.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

# The base patterns. Possessive forms of the same languages, so that long runs cost linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
#: All kinds in the order of spans.
KINDS = (*BASE, "iban", "ssn", "name", "address")

Span = tuple[str, int, int]

#: At most this many patterns of votes and features train the classifier, the most frequent first.
PATTERNS = 200_000


def luhn(digits: str) -> bool:
    odd = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in odd)) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]+", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the run before each @ back to the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _found(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """All matches of the base patterns and whether they hold."""
    if "@" in text:
        yield from (("email", a, b, True) for a, b in emails(text))
    for m in IP.finditer(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19:
            yield "card", *m.span(), luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """kind, start, end of the whole match in code points, by kind as listed and start."""
    return [(k, a, b) for k, a, b, good in _found(text) if good]


# -- candidates ----------------------------------------------------------------------

_MARK = r"\x20?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])\x20?|\x20@\x20?|@\x20"
_SAID = r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\x20?|\x20dot\x20"
_PART = r"[A-Za-z0-9-]{1,63}"
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'][^\W\d_]+)?"
WIDE = [
    (
        "email",
        re.compile(
            rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:(?:{_MARK}){_PART}(?:(?:{_SAID}|\x20?\.\x20?){_PART}){{1,4}}|\x20at\x20{_PART}(?:(?:{_SAID}){_PART}){{1,4}})(?![A-Za-z0-9-])"
        ),
    ),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:)(?:[0-9A-Fa-f]{1,4}|:(?=:))(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[./\x20_-]{1,3}[0-9]{4}){2,3}(?:[./\x20_-]{1,3}[0-9]{1,3})?(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+,./-])(?:00[0-9]{1,3}[\x20./-]{0,2})?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z/,-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")),
    (
        "name",
        re.compile(
            r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.?\x20|(?i:\b(?:my name is|i am|signed|sincerely|regards|ich heiße|je m'appelle|me llamo)),?\s)"
            r"(?P<own>" + _NAME + r"(?:\x20" + _NAME + r"){0,2})"
        ),
    ),
    (
        "address",
        re.compile(
            r"(?<![0-9A-Za-z])(?:[0-9]{1,5}\x20(?:" + _NAME + r"\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way)\b"
            r"|[0-9]{1,5},?\x20(?:rue|avenue|boulevard|calle|avenida)\x20(?:(?:de|du|la|des|del)\x20){0,2}" + _NAME + r"|[^\W\d_a-z][^\W\d_]+(?:straße|strasse|weg|gasse)\x20[0-9]{1,4})"
        ),
    ),
]
#: Texts in which no pattern can match are passed over; RE2 finds them in one pass.
_MAY = (
    r"@|[0-9][0-9 ()./_-]{7,}[0-9]|[0-9]\.[0-9]+\.|[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f]*:|::|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|(?i)[(\[{<]at[)\]}>]| at [a-z0-9-]{1,63} ?[(\[{<]?dot[)\]}> ]"
    r"|\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|señor|señora)\b|my name is|\bi am |signed|sincerely|regards|ich heiße|je m'appelle|me llamo"
    r"|[0-9] [^ ]+(?: [^ ]+){0,2} (?:street|st|avenue|ave|road|rd|lane|ln|drive|boulevard|blvd|court|way)\b|[0-9],? (?:rue|avenue|boulevard|calle|avenida) |(?:straße|strasse|weg|gasse) [0-9]"
)


class _Free:
    """Places that are taken, by blocks of characters, so that many spans cost little."""

    def __init__(self, spans: Iterator[tuple[int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            self._put(a, b)

    def _put(self, a: int, b: int) -> None:
        for k in range(a >> 8, (b >> 8) + 1):
            self.blocks.setdefault(k, []).append((a, b))

    def free(self, a: int, b: int) -> bool:
        return not any(s < b and a < t for k in range(a >> 8, (b >> 8) + 1) for s, t in self.blocks.get(k, ()))

    def take(self, a: int, b: int) -> bool:
        if free := self.free(a, b):
            self._put(a, b)
        return free


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, base: all base matches, those that don't hold too, and wide ones that meet no base span; each place and kind once."""
    out = {(k, a, b): good for k, a, b, good in _found(text)}
    taken = _Free((a, b) for (_, a, b), good in out.items() if good)
    for kind, wide in WIDE:
        for m in wide.finditer(text):
            a, b = m.span("own") if kind == "name" else m.span()
            if (kind != "phone" or 7 <= len(_digits(text[a:b])) <= 15) and taken.free(a, b):
                out.setdefault((kind, a, b), False)
    return [(*k, good) for k, good in sorted(out.items())]


# -- labelers ------------------------------------------------------------------------

# Gazetteers.
TLDS = frozenset("com org net edu gov io info biz de fr es uk us eu ch at it nl ca au co me app dev".split())
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
FIRST_NAMES = frozenset(
    "james john robert michael william david mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna peter thomas hans klaus jürgen "
    "wolfgang sabine petra ursula monika jean pierre marie michel philippe nathalie isabelle sophie josé juan carlos luis maría carmen ana pablo lucía elena emma noah".split()
)
NOT_NAMES = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december the a an not so very here".split())
CUES = {
    "email": "mail email e-mail contact write reach courriel correo".split(),
    "ip": "ip ipv4 ipv6 host address addr client server login".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono whatsapp".split(),
    "iban": "iban account bank konto compte cuenta".split(),
    "ssn": "ssn social security insurance".split(),
    "name": "name patient customer employee mr mrs ms dr herr frau".split(),
    "address": "address live lives street ship resident wohnt adresse domicilio".split(),
}
COUNTER = frozenset("version v release order invoice isbn issn ref item part article figure section page serial build ticket total price hash uuid commit doi width height rows".split())
PERSONAL = frozenset("my your his her our contact personal private mein meine mon ma mi su ihr ihre".split())

LABELERS = ("form", "check", "lookalike", "gazetteer", "stopped", "cue", "counter", "personal", "bounded")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|[0-9]{4}\x20?[-/]\x20?[0-9]{4}$")
_FORMS = {
    "email": re.compile(r"(?i)[a-z0-9._%+-]+(?:@|\x20?[(\[{<](?:at|@)[)\]}>]\x20?|\x20at\x20)[a-z0-9-]+(?:(?:\.|\x20?[(\[{<]dot[)\]}>]\x20?|\x20dot\x20)[a-z0-9-]+)*(?:\.|\x20?[(\[{<]dot[)\]}>]\x20?|\x20dot\x20)[a-z]{2,}$"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|[0-9A-Fa-f:]{6,39}$"),
    "card": re.compile(r"[3456][0-9]{12,18}$|[3456][0-9]{3}(?P<s>[\x20./_-])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}$"),
    "phone": re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,8}){1,4}$|\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|0[0-9]{1,4}[\x20/-]{1,2}[0-9\x20-]{5,}$"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?$"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    "name": re.compile(_NAME + r"(?:\x20" + _NAME + r"){1,2}$"),
    "address": re.compile(r"[0-9].*|.*[0-9]$"),
}


def _checked(kind: str, own: str) -> int:
    """A checksum or range: 1 holds, -1 doesn't, 0 there is none."""
    if kind == "card":
        return 1 if luhn(_digits(own)) else -1
    if kind == "iban":
        s = own.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if own[:3] in ("000", "666") or own[0] == "9" or own[4:6] == "00" or own[-4:] == "0000" else 1
    if kind == "ip":
        try:
            ipaddress.ip_address(own)
        except ValueError:
            return -1
        return 1
    if kind == "phone":
        return 1 if 9 <= len(_digits(own)) <= 15 else -1
    return 0


def _listed(kind: str, own: str, words: list[str]) -> int:
    if kind == "email":
        return 1 if words and words[-1] in TLDS else -1
    if kind == "iban":
        return 1 if own[:2] in COUNTRIES else -1
    if kind == "name":
        return 1 if words[0] in FIRST_NAMES else 0
    if kind == "address":
        return 1
    return 0


#: Features of a span for the classifier, besides its kind.
SHAPES = (
    "plus paren dash blank dot slash colon at letters mixed digits8 digits10 digits12 digits14 repeats cue counter personal check_good check_bad form listed dated capital bounded".split()
)


def votes_and_shapes(text: str, kind: str, a: int, b: int) -> tuple[tuple[int, ...], int]:
    """The labelers' votes on a candidate, and its features as bits."""
    own = text[a:b]
    before = _WORD.findall(text[max(0, a - 48) : a].lower())[-5:]
    near = {*before, *_WORD.findall(text[b : b + 24].lower())[:2]}
    words = _WORD.findall(own.lower())
    digits = _digits(own)
    dated = bool(_DATE.search(own)) or kind != "email" and bool(re.search(r"[0-9]{1,2}:[0-9]{2}$", own)) and "::" not in own
    form, check, listed = bool(_FORMS[kind].match(own)), _checked(kind, own), _listed(kind, own, words)
    cue, counter, personal = not near.isdisjoint(CUES[kind]), not COUNTER.isdisjoint(near), not PERSONAL.isdisjoint(near)
    left, right = text[a - 1 : a], text[b : b + 1]
    bounded = not (left.isalnum() or right.isalnum() or left in ("#", "_", "-") and left or right in ("_", "=") and right)
    same = len(digits) >= 6 and len(set(digits)) <= 2
    votes = (
        1 if form else -1, check, -1 if dated or same else 0, listed, -1 if kind == "name" and not NOT_NAMES.isdisjoint(words) else 0,
        1 if cue else 0, -1 if counter else 0, 1 if personal else 0, 0 if bounded else -1,
    )
    n = len(digits)
    bits = (
        "+" in own, "(" in own, "-" in own, " " in own, "." in own, "/" in own, ":" in own, "@" in own, not digits, bool(digits) and any(c.isalpha() for c in own), n >= 8, n >= 10,
        n >= 12, n >= 14, same, cue, counter, personal, check > 0, check < 0, form, listed > 0, dated, own[:1].isupper(), bounded,
    )
    return votes, sum(1 << i for i, x in enumerate(bits) if x)


# -- what the labelers are worth ------------------------------------------------------

Pattern = tuple[int, tuple[int, ...], int]  # number of the kind, votes, features


@dataclass
class Reliability:
    """prior[kind] of being personal, and chance[class, kind, labeler, vote + 1]."""

    prior: np.ndarray
    chance: np.ndarray

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        for j in range(votes.shape[1]):
            odds = odds + np.log(self.chance[1, kind, j, votes[:, j] + 1]) - np.log(self.chance[0, kind, j, votes[:, j] + 1])
        return 1 / (1 + np.exp(-odds))


def reliabilities(kind: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int = 60, strength: float = 20.0) -> Reliability:
    """Expectation-maximisation over patterns of votes with their counts, each kind by itself.

    It starts from labelers that vote rightly four times of five; that belief counts as ``strength`` candidates throughout,
    so labelers that hardly vote keep it, and it tells the two classes apart.
    """
    m = votes.shape[1]
    start = np.empty((2, len(KINDS), m, 3))
    start[1], start[0] = (0.12, 0.4, 0.48), (0.48, 0.4, 0.12)
    found = Reliability(np.full(len(KINDS), 0.5), start.copy())
    for _ in range(rounds):
        p = found.posterior(kind, votes)
        chance = strength * start
        for c, q in ((0, weight * (1 - p)), (1, weight * p)):
            for j in range(m):
                chance[c, :, j] += np.bincount(3 * kind + votes[:, j] + 1, q, 3 * len(KINDS)).reshape(-1, 3)
        prior = (np.bincount(kind, weight * p, len(KINDS)) + strength / 2) / (np.bincount(kind, weight, len(KINDS)) + strength)
        found = Reliability(prior, chance / chance.sum(3, keepdims=True))
    return found


@dataclass
class Classifier:
    """Logistic weights of kinds and features."""

    kind: np.ndarray
    shape: np.ndarray

    def probability(self, kind: np.ndarray, shape: np.ndarray) -> np.ndarray:
        bits = (shape[:, None] >> np.arange(len(SHAPES))) & 1
        return 1 / (1 + np.exp(-(self.kind[kind] + (bits * self.shape[kind]).sum(1))))


def classifier(kind: np.ndarray, shape: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 25, l2: float = 0.5) -> Classifier:
    """Fits probabilities ``p``, kind by kind, by Newton steps on the penalised likelihood."""
    bits = ((shape[:, None] >> np.arange(len(SHAPES))) & 1).astype(float)
    out = Classifier(np.zeros(len(KINDS)), np.zeros((len(KINDS), len(SHAPES))))
    for k in range(len(KINDS)):
        own = kind == k
        x, y = np.column_stack([np.ones(own.sum()), bits[own]]), p[own]
        v = np.log1p(weight[own])  # very frequent patterns don't drown the rest
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (v * q * (1 - q) + 1e-9)[:, None]).T @ x + l2 * np.eye(x.shape[1])
            w += np.linalg.solve(h, x.T @ (v * (y - q)) - l2 * w)
        out.kind[k], out.shape[k] = w[0], w[1:]
    return out


#: Made lines that show each kind once or more, so that a kind rare in the corpus is known. The labelers vote on them as on any other.
MADE = """my phone is (212) 736-5000 thanks|call 030 / 123 456 78 today|tel. 555-867-5309 now|fax 0171 2345678|order 123-456-789012 shipped|ref 2020 1234 5678 ok
mail me: jane dot doe [at] mail [dot] org|contact bob at example dot com please|write to x.y (at) web (dot) de|look at this . now then|version 1.2.3.4 is out|build 10.0.0.300 of it
ip 10.1.2.3 logged in|client 2001:db8:85a3::8a2e:370:7334 here|at 12:30:45:12 we met|host fe80::1ff:fe23:4567:890a up|card 4111 1111 1111 1111 visa|card 4111.1111.1111.1111 credit
item 1234 5678 9012 3456 total|serial 1111 1111 1111 1111|iban DE89 3704 0044 0532 0130 00 konto|account GB82WEST12345698765432|part AB12 CD34 EF56 7890|hash FF00 1234 5678 9012
ssn 536-90-4399 social|social security 219-09-9999|part 000-12-3456|order 987-65-4320|Dr. Anna Schmidt called|my name is John Miller and|I am Very tired|Mr. President Monday|I am The boss
regards, Marie Dupont|signed, December|I live at 12 Oak Street now|ship to 221 Baker Street please|my address is Hauptstraße 5 there|section 12 The Long Way home|10, rue de Rivoli|on 2024-01-02 2024-02-03 we
pages 1234-5678 of it|tel 1111 111 1111 there|price 12.50 3000.00 120.75|phone 0044 20 7946 0958""".replace("\n", "|").split("|")


def patterns(text: str) -> Counter[Pattern]:
    """How often each pattern occurs among the candidates of a text."""
    return Counter((KINDS.index(k), *votes_and_shapes(text, k, a, b)) for k, a, b, _ in candidates(text))


@dataclass
class Model:
    trust: Reliability
    final: Classifier

    def added(self, text: str, found: list[tuple[str, int, int, bool]]) -> list[Span]:
        """Candidates that the classifier takes: those that meet no base span and no likelier candidate."""
        rest = [(k, a, b) for k, a, b, base in found if not base]
        if not rest:
            return []
        shape = np.array([votes_and_shapes(text, *s)[1] for s in rest])
        p = self.final.probability(np.array([KINDS.index(k) for k, _, _ in rest]), shape)
        taken = _Free((a, b) for _, a, b, base in found if base)
        out = []
        for i in sorted(np.flatnonzero(p >= 0.5).tolist(), key=lambda i: (-p[i], rest[i][1], -rest[i][2], KINDS.index(rest[i][0]))):
            if taken.take(*rest[i][1:]):
                out.append(rest[i])
        return out


def trained(counts: Counter[Pattern]) -> Model:
    """The model from the patterns of a corpus; the made lines count once each."""
    both = counts + sum(map(patterns, MADE), Counter())
    rows = sorted(both.items())
    kind, shape, weight = (np.array(x) for x in zip(*((k, s, n) for (k, _, s), n in rows), strict=True))
    votes = np.array([v for (_, v, _), _ in rows])
    trust = reliabilities(kind, votes, weight.astype(float))
    return Model(trust, classifier(kind, shape, trust.posterior(kind, votes), weight.astype(float)))


@cache
def _code(n: int) -> tuple[int, ...]:
    """Votes from their number in base 3."""
    return tuple(n // 3**j % 3 - 1 for j in range(len(LABELERS)))


def _may(texts: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring_regex(texts, _MAY).fill_null(False).to_numpy(zero_copy_only=False)).tolist()


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the patterns of votes over all texts and trains; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int, int]] = Counter()

        def out() -> pa.RecordBatch:
            kind, votes, shape = zip(*seen, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(votes, pa.int32()), pa.array(shape, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "shape", "n"])

        for b in batches:
            for i in _may(b.column(0)):
                for (k, v, s), n in patterns(b.column(0)[i].as_py()).items():
                    seen[k, sum((x + 1) * 3**j for j, x in enumerate(v)), s] += n
            if len(seen) > 50_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    own = docs.select(F.col("`" + text_col.replace("`", "``") + "`").alias("text")).mapInArrow(run, "kind int, votes int, shape long, n long")
    rows = own.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "votes", "shape").limit(PATTERNS)
    return trained(Counter({(r.kind, _code(r.votes), r.shape): r.n for r in rows.collect()}))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one mark."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str], model: Model | None = None, mask: bool = False, prefix: str = "", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, n_email, n_ip, n_card, n_phone (base spans), n_added, base, spans; with ``mask`` also masked.

    ``base`` and ``spans`` are strings of kind:start:end, by kind and start. A null text counts as empty and is masked to null;
    repeated rows get equal results and an empty table none. Without a model one is trained on ``docs``. The new names take
    ``prefix``, for tables that have columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    names = [*(f"n_{k}" for k in BASE), "n_added"]
    kinds = [*((n, "long") for n in names), ("base", "string"), ("spans", "string"), *[("masked", "string")] * mask]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        own = shared.value

        def of(texts: pa.Array) -> list[pa.Array]:
            counts, base, spans = np.zeros((len(texts), len(names)), np.int64), [""] * len(texts), [""] * len(texts)
            covered = texts.to_pylist() if mask else []
            for i in _may(texts):
                text = texts[i].as_py()
                found = candidates(text)
                fixed, more = [(k, a, b) for k, a, b, good in found if good], own.added(text, found)
                counts[i] = [*(sum(s[0] == k for s in fixed) for k in BASE), len(more)]
                base[i], spans[i] = joined(fixed), joined([*fixed, *more])
                if mask:
                    covered[i] = masked(text, [*fixed, *more])
            return [*(pa.array(c) for c in counts.T), pa.array(base, pa.string()), pa.array(spans, pa.string()), *([pa.array(covered, pa.string())] if mask else [])]

        return of

    return appended(docs, keep, text_col, make, [(prefix + n, t) for n, t in kinds])
