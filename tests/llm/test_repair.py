"""Conversation repair against a plain search over all edits, the scan's algebra, and odd inputs."""

import hashlib
import random
import zlib
from itertools import groupby, product

import pytest
from quillon.llm import repair

TURNS = "conv_id long, turn long, role string, text string, part long, cost string, fault string"
SPACE = " \t\n\x0b\x0c\r"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) by a search that keeps the best (cost, audit, text) for each role string's end."""
    bad = faults(rows)
    best = {0: (0, "", [])}  # 0 nothing, 1 system, 2 user, 3 assistant

    def inserted(best):
        again = True
        while again:
            again = False
            for at, (c, a, said) in list(best.items()):
                to, role = (3, "assistant") if at == 2 else (2, "user")
                new = (c + 2, a + "I", [*said, role + ":"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to], again = new, True
        return best

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, bad, strict=True):
        new = {}

        def put(to, e, new=new):
            if to not in new or e[:2] < new[to][:2]:
                new[to] = e

        for at, (c, a, said) in best.items():
            put(at, (c + 3, a + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            to, name = (3, "assistant") if at == 2 else (2, "user")
            put(to, (c + 2 + more, a + "R", [*said, f"{name}:{text}"]))
            if role[:1] == name[0]:
                put(to, (c + more, a + "K", [*said, f"{role}:{text}"]))
            if at == 0 and role[:1] == "s":
                put(1, (c + more, a + "K", [*said, f"{role}:{text}"]))
        best = inserted(new)
    cost, audit, said = min((best[k] for k in (0, 3) if k in best), key=lambda e: e[:2])
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    return out | {k: plain(list(g)) for k, g in groupby(damage(rows), key=lambda r: r[0])}


def got(df):
    return {r.conv_id: tuple(r)[1:9] for r in df.collect()}


def some(rng, conv):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "sys", "assistant"]
    texts = ["Hi.", "hi", "What?", "  \t\n", "", None, "Done! \n", "é", "a:b\nuser:", "x" * 50]
    return [(conv, rng.choice([None, k, k, rng.randint(0, 30)]), rng.choice(roles), rng.choice(texts)) for k in range(rng.randint(1, 14))]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_equals_a_plain_search(spark, parts):
    rng, rows = random.Random(5), []
    for conv in [None, *range(150)]:
        rows += some(rng, conv)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = repair.repair(turns(spark, rows))
        assert got(found) == expected(rows)
        assert found.columns[-1] == "n_rows"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "tool"]), f"{rng.choice('abc')}{rng.randint(0, 900)}{rng.choice(['.', ''])}") for k in range(1500)]
    rows += [(1, 5000 + k, "user", "same.") for k in range(300)] + [(1, 9000, "assistant", "again.")] * 400 + [(2, 0, "user", "Q?"), (2, 1, "assistant", "z" * 300_000 + ".")]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        checked = repair.with_faults(repair.written(repair.damaged(turns(spark, rows)), "t"))
        assert repair.stretches(checked).where("conv_id = 1").count() > 4
        assert got(repair.repair(turns(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_products_may_be_taken_in_any_grouping():
    kinds = [repair.turn_matrix(i, f) for i, f in product("sua t", ["", "truncated", "blank"])]
    rng = random.Random(2)
    for _ in range(300):
        a, b, c = (rng.choice(kinds) for _ in range(3))
        assert repair._times(repair._times(a, b), c) == repair._times(a, repair._times(b, c))
        assert repair._times(repair.ONE, a) == a == repair._times(a, repair.ONE)
    a = repair.ONE
    for m in (ms := [rng.choice(kinds) for _ in range(37)]):
        a = repair._times(a, m)
    p = repair.Product()
    for m in ms:
        p.add(m)
    assert p.value() == a
    assert repair.Product().value() == repair.ONE


def test_empty_table_and_all_turns_dropped(spark):
    assert repair.repair(turns(spark, []).where("false")).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(repair.repair(turns(spark, [(gone, 0, "user", "x")]))) == expected([(gone, 0, "user", "x")])


def test_other_kinds_of_ids(spark):
    rows = [("c-3", k, r, t) for k, (r, t) in enumerate([("system", "s."), ("user", "a."), ("tool", "b"), ("user", ""), ("user", "e!")])]
    d = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert got(repair.repair(d)) == {"c-3": plain([r for r in damage_any(rows)])}


def damage_any(rows):
    """``damage`` of one conversation with any kind of id."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out
