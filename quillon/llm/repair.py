"""Conversation structure repair: a min-plus scan of 4x4 matrices.

A repaired conversation has the roles ``(s?(ua)+)?``. Four states tell what stands so far: nothing, a system turn, a
user turn last, an assistant turn last. A turn is a matrix of the cheapest edits from state to state; an element
is (cost, audit), the audit being the initials of the edits. Elements add by the lesser one and multiply by summing costs and
joining audits. After each turn stands the closure of insertions (any number of them; more than two never pay).

The product is associative and keeps the order of equally dear audits: all audits of an element edit the same turns, so two of
one cost are never each other's beginning, and what follows can't change which is less. So any stretch of turns reduces
to one matrix by itself: turns are sorted by range over the cluster, each task reduces its stretches in pairs, and a conversation's few
stretches (one for each task that has some of it) are multiplied in order. No task needs a whole conversation until its text is
hashed, which is a stream: its turns pass one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
ENDS = ".!?"
_BLANK = "[\\x20\\x09-\\x0D]"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]

ONE: Matrix = tuple(tuple((0, "") if i == k else None for k in range(4)) for i in range(4))


def _times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        have = [(k, e) for k, e in enumerate(row) if e is not None]
        new: list[Element] = []
        for j in range(4):
            best: Element = None
            for k, (c, s) in have:
                if (e := b[k][j]) is not None:
                    cost = c + e[0]
                    if best is None or cost < best[0] or cost == best[0] and s + e[1] < best[1]:
                        best = (cost, s + e[1])
            new.append(best)
        out.append(tuple(new))
    return tuple(out)


#: Any number of insertions.
CLOSURE: Matrix = tuple(
    tuple((n * INSERT_COST, n * INSERT) if n is not None else None for n in row) for row in ((0, None, 1, 2), (None, 0, 1, 2), (None, None, 0, 1), (None, None, 1, 0))
)


def turn_matrix(initial: str, fault: str) -> Matrix:
    """The cheapest edits of one turn, and insertions after it. ``fault``: blank, duplicate, truncated or empty."""
    m: list[list[Element]] = [[(DELETE_COST, DELETE) if i == k else None for k in range(4)] for i in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED_COST if fault == "truncated" else 0
        for old, new, letter in ((START, SYSTEM, "s"), (START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")):
            if initial == letter:
                m[old][new] = (more, KEEP)
            elif new != SYSTEM:
                m[old][new] = (REROLE_COST + more, REROLE)
    return _times(tuple(map(tuple, m)), CLOSURE)


def deletions(n: int) -> Matrix:
    """``n`` turns that must go, and insertions after them; insertions among them would only come earlier in the order and be greater."""
    return _times(tuple(tuple((n * DELETE_COST, n * DELETE) if i == k else None for k in range(4)) for i in range(4)), CLOSURE)


class Product:
    """Multiplies matrices in order, in pairs of equal length, so that long audits are joined few times."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        n = 1
        while self.held and self.held[-1][0] <= n:
            k, left = self.held.pop()
            n, m = n + k, _times(left, m)
        self.held.append((n, m))

    def value(self) -> Matrix:
        out = ONE
        for _, m in reversed(self.held):
            out = _times(m, out)
        return out


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation whose turns have the product ``m``."""
    row = _times((CLOSURE[START],), m)[0]
    return min(e for e in (row[START], row[ASSISTANT]) if e is not None)


# -- damage ------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the turns after damage, n times each; a dropped turn has n = 0 and keeps its conversation known.

    Equal turns of a conversation (turn, role and text) are one row from here on.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), f"[{ENDS}]", "")).otherwise(space("text"))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), F.when(kind == 0, "").otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _key(*columns: str) -> Column:
    """A digest of a conversation, role and text that are none of them confused."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, that of a row's first copy: blank, duplicate, truncated or empty. ``rows`` is a written table of ``damaged``.

    A row is a duplicate if its role and text stand at an earlier turn; only those that stand at several are looked up, by the
    earliest of them, and hot ones are broadcast.
    """
    own = rows.withColumn("_key", _key("conv_id", "role", "text"))
    there = own.where("n > 0").groupBy("_key").agg(F.count("*").alias("_rows"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"))
    again = written(there.where("_rows > 1"), "repeated-turns")
    total = rows.count()
    met = join_groups(own, again, "_key", "_rows", total)
    blank = F.regexp_replace("text", _BLANK + "+", "") == ""
    later = F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("_first")
    last = F.substring(F.regexp_replace("text", _BLANK + r"+\z", ""), -1, 1)
    fault = F.when(F.col("n") == 0, "").when(blank, "blank").when(F.coalesce(later, F.lit(False)), "duplicate").when(~last.isin(*ENDS), "truncated").otherwise("")
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


# -- scan --------------------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: What a stretch of a conversation tells: its turns, its ends, its counts, and its matrix in two lists of 16.
_STRETCH = (
    "conv_id {conv}, part long, rows long, turns long, low {turn}, high {turn}, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)


class Stretch:
    """Turns of one conversation in order."""

    def __init__(self, conv: object):
        self.conv, self.product, self.rows, self.turns = conv, Product(), 0, 0
        self.low = self.high = self.first = self.last = None
        self.n = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: object, role: str, n: int, fault: str, known: dict) -> None:
        if not n:
            return
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.n["illegal"] += n - 1 + (self.rows > 0 and self.last + initial not in LEGAL)
        if fault:
            self.n[fault] += 1
        if n > 1:
            self.n["blank" if fault == "blank" else "duplicate"] += n - 1
        if (m := known.get((initial, fault))) is None:
            m = known[initial, fault] = turn_matrix(initial, fault)
        self.product.add(m)
        if n > 1:
            self.product.add(deletions(n - 1))
        self.first, self.last, self.rows = self.first if self.rows else initial, initial, self.rows + n

    def row(self, part: int) -> list:
        flat = [e for r in self.product.value() for e in r]
        costs, audits = [e and e[0] for e in flat], [e and e[1] for e in flat]
        return [self.conv, part, self.rows, self.turns, self.low, self.high, self.first, self.last, *self.n.values(), costs, audits]


def stretches(rows: DataFrame) -> DataFrame:
    """The conversations' stretches, one for each conversation in each task. Rows are dealt by range of conversation, turn, role and text."""
    kinds = dict(rows.dtypes)
    schema = _STRETCH.format(conv=kinds["conv_id"], turn=kinds["turn"])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, known, out, size = TaskContext.get().partitionId(), {}, [], 0
        fields, now, arrow = None, None, None
        for b in batches:
            fields = fields or b.schema
            arrow = arrow or _arrow(fields)
            for conv, turn, role, n, fault in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "n", "fault")), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.row(part))
                        size += sum(map(len, filter(None, out[-1][-1])))
                    if len(out) >= 2000 or size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out, size = [], 0
                    now = Stretch(conv)
                now.add(turn, role, n, fault, known)
        if now:
            out.append(now.row(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.drop("text").mapInArrow(run, schema)


def _arrow(fields: pa.Schema) -> pa.Schema:
    conv, turn = fields.field("conv_id").type, fields.field("turn").type
    kinds = [("conv_id", conv), ("part", pa.int64()), ("rows", pa.int64()), ("turns", pa.int64()), ("low", turn), ("high", turn), ("first", pa.string()), ("last", pa.string())]
    return pa.schema([*kinds, *[(c, pa.int64()) for c in _COUNTS], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


class Whole:
    """A conversation: its stretches in order, then its turns in order."""

    def __init__(self, conv: object):
        self.conv, self.product, self.rows, self.turns = conv, Product(), 0, 0
        self.low = self.high = self.last = None
        self.n = dict.fromkeys(_COUNTS, 0)
        self.cost, self.audit, self.at, self.state, self.sha, self.some = 0, None, 0, START, hashlib.sha256(), False

    def stretch(self, s: dict) -> None:
        for c in _COUNTS:
            self.n[c] += s[c]
        if not s["rows"]:
            return
        self.n["illegal"] += self.rows > 0 and self.last + s["first"] not in LEGAL
        if s["turns"]:
            self.turns += s["turns"] - (s["low"] == self.high)
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        self.rows, self.last = self.rows + s["rows"], s["last"]
        flat = [None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)]
        self.product.add(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)))

    def plan(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(self.product.value()) if self.rows else (0, "")

    def say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some = True
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def _wanted(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.say(self._wanted(), "")
            self.at += 1

    def turn(self, role: str, text: str, n: int) -> None:
        self.plan()
        for _ in range(n):
            self._insertions()
            edit = self.audit[self.at]
            self.at += 1
            if edit == KEEP:
                self.say(role, text)
            elif edit == REROLE:
                self.say(self._wanted(), text)

    def row(self) -> list:
        self.plan()
        self._insertions()
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return [self.conv, gaps, *self.n.values(), self.cost, self.audit, self.sha.hexdigest(), self.rows]


def repair(turns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256, n_rows (turns after damage).

    ``rows`` replaces the damaged turns by others of the same shape (as ``damaged`` gives them). Turns are in the order of turn
    (nulls first), then role, then text, in byte order. A null conv_id is a conversation of its own, a null role or text is one
    blank. A turn's role is known by its first letter. Other columns don't matter. Of n equal turns the later n - 1 are duplicates (blank ones: blank).
    """
    rows = written(damaged(turns) if rows is None else rows, "damaged-turns")
    kinds = dict(rows.dtypes)
    checked = written(with_faults(rows), "checked-turns")
    parts = stretches(checked)
    schema = f"conv_id {kinds['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
    both = parts.unionByName(checked.where("n > 0").select("conv_id", "turn", "role", "text", "n"), allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), F.col("part").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, conv_type = [], None, None

        def batch() -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]
            names = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256", "n_rows"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for s in b.to_pylist():
                if now is None or s["conv_id"] != now.conv:
                    if now:
                        out.append(now.row())
                    if len(out) >= 1000:
                        yield batch()
                        out = []
                    now = Whole(s["conv_id"])
                if s["part"] is not None:
                    now.stretch(s)
                else:
                    now.turn(s["role"], s["text"], s["n"])
        if now:
            out.append(now.row())
            yield batch()

    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)
