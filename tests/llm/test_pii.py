"""Personal data: base spans against the plain patterns, trust in labelers that is known, held-out settings, odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import pii
from quillon.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, spans string, n_ip string, kind string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def holds(kind, own):
    d = [int(c) for c in own if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in own.split("."))
    if kind == "card":
        twice = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def some(rng):
    bits = ["4111111111111111", "4111 1111-1111 1111", "a.b@c.de", "x@y", "@", "a@b.c@d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.03.4", "+1 (652) 555-4544", "+49 30 1234567 ", "+", "-", " ", "  ", "0", "12",
            "é", "٣", "١٢", "😀", "\n", ".", "..", "word", "%", "(", ")", "0000000000000", "5500 0000 0000 0004", "+123", "a@é.com", "a_b@c-d.e-", "-@-.-"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    for _ in range(6000):
        t = some(rng)
        assert sorted(pii.base_spans(t)) == sorted(plain(t)), t
        if plain(t):
            assert pii._may(pa.array([t])) == [0], t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "1 " * 100_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a@" * 50_000, "A" * 100_000 + "@a.b", "1:" * 50_000, "Mr. " * 20_000, "a at b dot " * 10_000):
        pii.candidates(t)


def test_whole_tables(spark):
    rows = {r.doc_id: r for r in Q.queries()["op12_pii"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, r = plain(d.text), rows[d.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in PLAIN)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_reliabilities_recover_what_made_the_votes():
    rng = np.random.default_rng(3)
    n, m = 40_000, len(pii.LABELERS)
    truth = rng.random(n) < 0.3
    right = np.linspace(0.55, 0.95, m)
    silent = np.full(m, 0.3)
    vote = np.where(rng.random((n, m)) < silent, 0, np.where((rng.random((n, m)) < right) == truth[:, None], 1, -1))
    rows, count = np.unique(vote, axis=0, return_counts=True)
    found = pii.reliabilities(np.zeros(len(rows), int), rows, count.astype(float))
    p = found.posterior(np.zeros(n, int), vote)
    assert abs(found.prior[0] - 0.3) < 0.03
    assert np.abs(found.chance[1, 0, :, 2] - 0.7 * right).max() < 0.03
    assert np.abs(found.chance[0, 0, :, 0] - 0.7 * right).max() < 0.03
    known = np.stack([np.stack([0.7 * r, silent, 0.7 * w], 1) for r, w in ((right, 1 - right), (1 - right, right))])[:, None].repeat(len(pii.KINDS), 1)
    best = pii.Reliability(np.full(len(pii.KINDS), 0.3), known).posterior(np.zeros(n, int), vote)
    assert ((p > 0.5) == truth).mean() > ((best > 0.5) == truth).mean() - 0.002  # as good as who knows the chances
    assert ((p > 0.5) == truth).mean() > ((vote.sum(1) > 0) == truth).mean()  # better than counting votes


def test_classifier_is_the_likeliest():
    rng = np.random.default_rng(5)
    shape = rng.integers(0, 1 << len(pii.SHAPES), 400)
    bits = (shape[:, None] >> np.arange(len(pii.SHAPES))) & 1
    p = 1 / (1 + np.exp(-(bits[:, 0] * 2.0 - bits[:, 3] * 1.5)))
    found = pii.classifier(np.ones(400, int), shape, p, np.ones(400))
    w = np.concatenate([[found.kind[1]], found.shape[1]])
    x = np.column_stack([np.ones(400), bits])
    q = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (np.log(2) * (p - q)) - 0.5 * w).max() < 1e-6  # the gradient is nothing


HELD_OUT = {
    "email": (["reach me by mail: {w}.{w} [at] {w} [dot] com", "contact {w} at {w} dot org", "e-mail {w} (at) {w}.net today"], ["we met at noon . then {w} left", "{w} at the {w}. And so"]),
    "phone": (["call ({d3}) {d3}-{d4} now", "my mobile is {d3}-{d3}-{d4}", "phone: 0044 20 {d4} {d4}"], ["order {d3}-{d3}-{d4}{d4}", "pages {d4} - {d4}", "it rose from 12.50 to 1300.75 in all", "on 2021-04-05 it was {w}"]),
    "iban": (["iban DE89370400440532013000", "to account GB82 WEST 1234 5698 7654 32"], ["part XY12 {d4} {d4} AB{d2}", "hash FF00 {d4} {d4} {d4}"]),
    "ssn": (["social security 536-90-4399", "ssn 219-09-9999"], ["part 000-{d2}-{d4}", "order 9{d2}-{d2}-{d4}"]),
    "name": (["Dr. Peter Weber said", "my name is Laura Gómez and", "Frau Anna Keller kommt"], ["I am Here now", "signed, Monday"]),
    "address": (["I live at 12 Willow Street", "ship to 9, rue de Lyon"], ["chapter 5 of the street"]),
    "ip": (["client 2001:db8:0:1:2:3:4:5 logged in", "host fe80::1"], ["at 10:20:30:40 we", "build 1.2.3.999"]),
}


def made(rng, t):
    for k in ("d2", "d3", "d4"):
        while "{" + k + "}" in t:
            t = t.replace("{" + k + "}", "".join(rng.choice("123456789") for _ in range(int(k[1]))), 1)
    while "{w}" in t:
        t = t.replace("{w}", "".join(rng.choice("abcdefghij") for _ in range(6)), 1)
    return t


@pytest.mark.parametrize("kind", sorted(HELD_OUT))
def test_settings_that_training_has_not_seen(kind):
    rng, m = random.Random(6), pii.trained(Counter())
    found = {True: 0, False: 0}
    for good, lines in zip((True, False), HELD_OUT[kind], strict=True):
        for line in lines * 30:
            t = made(rng, line)
            found[good] += any(s[0] == kind for s in m.added(t, pii.candidates(t)))
    assert found[True] >= 0.9 * 30 * len(HELD_OUT[kind][0])
    assert found[False] <= 0.05 * 30 * len(HELD_OUT[kind][1])


ODD = [None, "", " ", "x" * 300_000 + " a.b@c.de " + "9" * 100_000, "é😀 +1 (652) 555-4544", "é😀 +1 (652) 555-4544", "call (212) 736-5000 or 1.2.3.4", "\x00@\x00"]


def test_odd_rows_and_masks(spark):
    rows = sorted(pii.scan(docs(spark, *ODD), ["doc_id", "spans", "kind"], mask=True, prefix="_").collect(), key=lambda r: r.doc_id)
    assert [r._base for r in rows[:3]] == [""] * 3 and [r._masked for r in rows[:3]] == [None, "", " "]
    assert rows[3]._base == "email:300001:300009"
    assert rows[4]._base == rows[5]._base == "phone:3:20" and rows[4]._masked == "é😀 <PHONE>"
    assert (rows[6]._n_ip, rows[6]._n_added, rows[6]._spans) == (1, 1, "ip:23:30,phone:5:19") and rows[6]._masked == "call <PHONE> or <IP>"
    assert {r.spans for r in rows} == {"x"} and rows[7]._spans == ""
    assert pii.scan(docs(spark, "a").where("false"), ["doc_id"]).count() == 0


def test_what_is_counted_equals_a_plain_count(spark, monkeypatch):
    texts = [*ODD, *pii.MADE, *pii.MADE[:9]]
    got = []
    monkeypatch.setattr(pii, "trained", lambda c: got.append(c) or pii.Model(None, pii.Classifier(np.zeros(8), np.zeros((8, len(pii.SHAPES))))))
    pii.fit(docs(spark, *texts).repartition(3))
    assert got[0] == sum((pii.patterns(t or "") for t in texts), Counter())
