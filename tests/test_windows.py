"""Windows of a text alike to a phrase: what the bounds pass over, and nothing else."""

import random
from difflib import SequenceMatcher

from quillon.functions import fuzzy

WORDS = "rava nolu teki sami dorel pinat gusko melta virun hasti".split()


def _every(phrases, text):
    t, out = fuzzy.normalized(text), []
    words = t.split(" ")
    for k, p in enumerate(map(fuzzy.normalized, phrases)):
        n = len(p.split())
        best = max(SequenceMatcher(None, p, " ".join(words[i : i + n])).ratio() for i in range(max(1, len(words) - n + 1)))
        if p in t or best >= fuzzy.LEAST_RATIO:
            out.append((k, 1.0 if p in t else round(best, 6)))
    return out


def test_windows_of_few_words_give_what_every_window_gives(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(fuzzy, "LETTERS", 300)
    monkeypatch.setattr(fuzzy, "SHARED", 500)
    monkeypatch.setattr(fuzzy, "TOGETHER", 7)
    phrases = [" ".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(70)]
    found = 0
    for _ in range(4):
        parts = []
        for p in rng.sample(phrases, 4):
            rate = rng.choice([0.03, 0.1, 0.15])
            parts.append("".join(rng.choice("qz ") if rng.random() < rate else c for c in p if rng.random() > rate / 2))
        text = " ".join([*parts, *rng.choices(WORDS, k=30)])
        got = fuzzy.Phrases(phrases).matches(text)
        assert got == _every(phrases, text)
        found += sum(r < 1 for _, r in got)
    assert found > 2


def test_shared_trigrams_in_other_places_measure_no_window(monkeypatch):
    first, second = " ".join(WORDS[:5] * 3), "kolbe wundi zarto fexim joluq " * 3
    measured = []
    monkeypatch.setattr(fuzzy.Phrases, "_common", lambda self, *a, own=getattr(fuzzy.Phrases, "_common", None): (measured.append(a), own(self, *a))[1], raising=False)
    monkeypatch.setattr(fuzzy, "_common", lambda *a: measured.append(a) or 0, raising=False)
    assert fuzzy.Phrases([f"{first} {second}"]).matches(f"{second} {first}") == [] and not measured


SYLLABLES = "th er on in re an ea st en at or hi ing tion ble nd of es it is".split()


def _prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def test_phrases_within_words_are_found():
    assert fuzzy.Phrases(["nan", "ana b", "zz"]).matches("Banana. Bread") == [(0, 1.0), (1, 1.0)]


def test_texts_together_and_long_windows_give_what_every_window_gives(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(fuzzy, "TOGETHER", 50)
    phrases = [_prose(rng, n) for n in (3, 18, 22, 30, 36, 40, 44, 52, 60)] + ["the of", "", "zz, zq"]
    texts = ["", "of", _prose(rng, 10)]
    for rate in (0.04, 0.08, 0.1, 0.12, 0.14):
        for p in phrases[:9]:
            spoiled = "".join(rng.choice("etzq ") if rng.random() < rate else c for c in p if rng.random() > rate / 2)
            texts.append(f"{_prose(rng, 4)} {spoiled} {_prose(rng, 4)}")
    want = [(n, k, r) for n, t in enumerate(texts) if t for k, r in _every([p for p in phrases if p], t)]
    place = [k for k, p in enumerate(phrases) if p]
    assert sum(0.85 <= r < 0.9 for *_, r in want) > 3
    for letters in (200, 1 << 16):
        monkeypatch.setattr(fuzzy, "LETTERS", letters)
        assert sorted(fuzzy.Phrases(phrases).search(texts)) == [(n, place[k], r) for n, k, r in want]


def test_few_windows_of_prose_are_measured(monkeypatch):
    rng = random.Random(4)
    measured, own = [], fuzzy.Phrases._common
    monkeypatch.setattr(fuzzy.Phrases, "_common", lambda self, letters, k, x, y: (measured.append(len(k)), own(self, letters, k, x, y))[1])
    phrases, words = [_prose(rng, rng.randint(15, 60)) for _ in range(60)], 1500
    fuzzy.Phrases(phrases).matches(_prose(rng, words))
    assert sum(measured) < len(phrases) * words / 500
