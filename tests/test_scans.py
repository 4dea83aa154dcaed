"""Running values over hot keys: the same rows as with one task for a key, over many ranges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals as I
from quillon.operators import scans


def intervals(spark, seed=1, n=600, hot=0.9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 7 if rng.random() < hot else rng.choice([None, 1, 2])
        start = float(rng.choice([rng.randint(-500, 4000), rng.randint(0, 60)]))
        rows.append((i, key, start, start + rng.choice([0.0, 1.0, 5.0, 40.0]), rng.choice([None, rng.random()])))
    return spark.createDataFrame(rows, "id long, video_id long, start_sec double, end_sec double, value double").repartition(5)


@pytest.fixture(params=[10_000, 50, 0], ids=["no hot key", "a hot key", "all keys hot"])
def hot_rows(request, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", request.param)
    return request.param


def by_key(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.start_sec, r.end_sec, r.id)):
        out[r.video_id].append(r)
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_values(spark, hot_rows, inclusive, reverse):
    df = intervals(spark)
    o = scans.Ordered(df, ["video_id"], ["start_sec", "end_sec", "id"])
    for how in ("max", "sum", "last"):
        o = o.running(how, "value", how, inclusive, reverse)
    got = {r.id: (r["max"], r["sum"], r["last"]) for r in o.rows().collect()}
    for rows in by_key(df).values():
        rows = rows[::-1] if reverse else rows
        for i, r in enumerate(rows):
            seen = [x.value for x in rows[: i + inclusive] if x.value is not None]
            want = (max(seen), sum(seen), seen[-1]) if seen else (None, None, None)
            assert got[r.id] == pytest.approx(want) if seen else got[r.id] == want
    assert len(got) == 600


def test_a_hot_key_lies_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", 100)
    o = scans.Ordered(intervals(spark), ["video_id"], ["start_sec", "end_sec", "id"])
    (cold, _), (hot, by) = o.parts
    assert by == ["video_id", "_range"] and cold.where("video_id = 7").isEmpty() and hot.where("video_id <> 7 or video_id is null").isEmpty()
    sizes = [r["count"] for r in hot.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)


def test_previous_values_may_be_null(spark, hot_rows):
    df = intervals(spark)
    o = scans.previous(scans.Ordered(df, ["video_id"], ["start_sec", "end_sec", "id"]), "p", "value")
    got = {r.id: r.p for r in scans.previous(o, "q", "value", reverse=True).rows().withColumn("p", F.struct("p", "q")).collect()}
    for rows in by_key(df).values():
        for i, r in enumerate(rows):
            assert tuple(got[r.id]) == (rows[i - 1].value if i else None, rows[i + 1].value if i + 1 < len(rows) else None)


def test_interval_operators_equal_brute_force(spark, hot_rows):
    df = intervals(spark)
    spans, total = [], {}
    for key, rows in by_key(df).items():
        for r in rows:
            if spans and spans[-1][0] == key and r.start_sec <= spans[-1][2] + 3.0:
                spans[-1][2:] = [max(spans[-1][2], r.end_sec), spans[-1][3] + 1]
            else:
                spans.append([key, r.start_sec, r.end_sec, 1])
        end, total[key] = float("-inf"), 0.0
        for r in rows:
            total[key], end = total[key] + max(0.0, r.end_sec - max(r.start_sec, end)), max(end, r.end_sec)
    merged = I.merged(df, ["video_id"], 3.0)
    assert sorted(map(str, map(list, merged.collect()))) == sorted(map(str, spans))
    assert {r.video_id: r.union_seconds for r in I.union_duration(df, ["video_id"]).collect()} == total
    gaps = [(a[0], a[2], b[1]) for a, b in zip(spans, spans[1:], strict=False) if a[0] == b[0]]
    assert sorted(map(str, map(tuple, I.gaps(merged, ["video_id"]).collect()))) == sorted(map(str, gaps))


def test_as_of_and_nearest_equal_brute_force(spark, hot_rows):
    df = intervals(spark).where("video_id is not null")
    a, b = df.where("id % 3 = 0"), df.where("id % 3 > 0")
    right = b.groupBy("video_id", "start_sec").agg(F.max("id").alias("sub"))
    got = {r.id: r.sub for r in I.as_of(a, right, ["video_id"], "start_sec", ["sub"]).collect()}
    near = {r.id: (r.nearest_id, r.dist) for r in I.nearest(a, b, ["video_id"]).collect()}
    others = by_key(b)
    for key, rows in by_key(a).items():
        for r in rows:
            before = [(x.start_sec, x.id) for x in others[key] if x.start_sec <= r.start_sec]
            assert got[r.id] == (max(before)[1] if before else None)
            best = min(((max(0.0, x.start_sec - r.end_sec, r.start_sec - x.end_sec), x.id) for x in others[key]), default=None)
            assert near.get(r.id) == ((best[1], best[0]) if best else None)


def test_empty_table(spark, hot_rows):
    df = intervals(spark).where("false")
    assert I.merged(df, ["video_id"]).count() == I.union_duration(df, ["video_id"]).count() == 0
