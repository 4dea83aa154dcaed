"""Streams with named state, stopped and started anew between batches, against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from quillon.streaming import guards as G

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def runs(spark, tmp_path, schema, batches, make):
    """Rows of each run: a batch of files comes, the query starts from its checkpoint, takes all there is, and stops."""
    got = []
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        with G.started(spark):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
        got.append(rows)
    return got


@pytest.mark.parametrize("parts", [1, 4])
def test_a_ledger_is_the_same_in_any_batches(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(1, 3), rng.randint(1, 25), seq, round(rng.uniform(1, 40), 2)) for seq in range(80)]
    cuts = [0, *sorted(rng.sample(range(1, 80), parts - 1)), 80]
    got = runs(spark, tmp_path, "account long, charge_id long, seq long, amount double", [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], lambda s: G.ledger(s, 200.0))[-1]
    spent, seen, want = {}, set(), []
    for account, charge, seq, amount in rows:
        if (account, charge) not in seen:
            seen.add((account, charge))
            spent[account] = spent.get(account, 0.0) + amount
            want.append((account, charge, seq, pytest.approx(spent[account]), spent[account] <= 200.0))
    assert [tuple(r) for r in sorted(got, key=lambda r: r.seq)] == want and {w[-1] for w in want} == {True, False}


def attempts(rows):
    """state and refusal of every event, without timers."""
    cases, out = {}, []
    follows = {("sent", "response_saved"), ("response_saved", "validated"), ("validated", "checkpointed"), ("sent", "technical_failure"), ("response_saved", "technical_failure"), ("technical_failure", "checkpointed")}
    for case, stage, n, event, seq, _ in rows:
        own = cases.setdefault(case, {})
        now = own.get((stage, n))
        if event == "begin":
            open_ = [f"{s}/{k}={v}" for (s, k), v in sorted(own.items()) if v != "checkpointed"]
            refusal = f"exists: {now}" if now else f"unfinished: {open_[0]}" if open_ else None
            new = "sent"
        else:
            refusal, new = (None, event) if (now, event) in follows else (f"{event} after {now or 'nothing'}", None)
        if not refusal:
            own[stage, n] = new
        out.append((case, stage, n, event, seq, own.get((stage, n)), refusal))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_attempts_are_made_once(spark, tmp_path, parts):
    rng = random.Random(7)
    events = ["begin", "begin", "response_saved", "validated", "checkpointed", "technical_failure"]
    rows = [(rng.randint(1, 2), rng.choice("ab"), rng.randint(1, 2), rng.choice(events), seq, T0 + timedelta(seconds=seq)) for seq in range(120)]
    cuts = [0, *sorted(rng.sample(range(1, 120), parts - 1)), 120]
    got = runs(spark, tmp_path, "case_id long, stage string, attempt long, event string, seq long, at timestamp", [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], lambda s: G.guarded(s, 10_000))[-1]
    assert [tuple(r) for r in sorted(got, key=lambda r: r.seq)] == attempts(rows)
    assert sum(r.refusal is None for r in got) > 8


def test_an_attempt_without_an_answer_blocks_its_case(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "a", 1, "begin", 1, at(0)), (2, "a", 1, "begin", 2, at(1)), (2, "a", 1, "response_saved", 3, at(2))],
        [(9, "z", 1, "begin", 4, at(500))],  # time goes on: the first one's answer is late
        [(1, "a", 1, "response_saved", 5, at(501)), (1, "a", 2, "begin", 6, at(502)), (2, "a", 1, "validated", 7, at(503)), (2, "a", 1, "checkpointed", 8, at(504)), (2, "a", 2, "begin", 9, at(505))],
    ]
    got = runs(spark, tmp_path, "case_id long, stage string, attempt long, event string, seq long, at timestamp", batches, lambda s: G.guarded(s, 60))
    assert ("timer", "ambiguous") not in [(r.event, r.state) for r in got[0]]
    assert [(r.case_id, r.event, r.state) for r in got[1] if r.event == "timer"] == [(1, "timer", "ambiguous")]
    end = {r.seq: (r.state, r.refusal) for r in got[2] if r.event != "timer"}
    assert end[5] == ("ambiguous", "response_saved after ambiguous") and end[6] == (None, "unfinished: a/1=ambiguous")
    assert end[8] == ("checkpointed", None) and end[9] == ("sent", None)


def test_tasks_end_once(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("a", "start", at(0)), ("b", "start", at(1)), ("a", "finish", at(30)), ("c", "finish", at(5)), ("d", "start", at(2)), ("d", "finish", at(90))],
        [("e", "start", at(200)), ("b", "start", at(201))],
        [("b", "finish", at(202)), ("a", "finish", at(203)), ("e", "finish", at(259)), ("f", "start", at(204))],
    ]
    got = runs(spark, tmp_path, "task string, event string, at timestamp", batches, lambda s: G.task_ends(s, 60))
    ms = lambda s: int(at(s).timestamp() * 1000)
    ends = [{(r.task, r.state, r.at_ms) for r in x} for x in got]
    assert {("a", "finished", ms(30)), ("d", "timeout", ms(62))} <= ends[0] and ("b", "timeout", ms(61)) in ends[1]
    assert ends[2] == {("a", "finished", ms(30)), ("d", "timeout", ms(62)), ("b", "timeout", ms(61)), ("e", "finished", ms(259))} and len(got[2]) == 4


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    seen = []
    schema = "k long, text string"

    def run():
        work = lambda s: s.select("k")
        out = G.resumed(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), work, str(tmp_path / "state"))
        seen.append(sorted(r.k for r in out.collect()))

    for batch in ([(1, "a"), (2, "b")], [], [(3, "c"), (1, "again")]):
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert seen == [[1, 2], [1, 2], [1, 1, 2, 3]]


class Store:
    """A handle whose values lie in memory; it counts what a processor asks of it."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def get(self):
                outer.calls += 1
                return outer.values.get(name)

            def update(self, v):
                outer.calls += 1
                outer.values[name] = v

            def clear(self):
                outer.values.pop(name, None)

        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs


def called(processor, store, rows, columns, ms=0):
    import pandas as pd

    processor.init(store)
    return [r for df in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), Clock(ms)) for r in df.itertuples(index=False, name=None)]


def test_keys_of_a_bucket_share_calls_and_state():
    n, store = 500, Store()
    got = called(G.Ledger(10.0, None), store, [(a, c, 2 * a + c, 6.0) for a in range(n) for c in (0, 1, 1)], ["account", "charge_id", "seq", "amount"])
    assert sorted(got) == [(a, c, 2 * a + c, 6.0 * (c + 1), c == 0) for a in range(n) for c in (0, 1)] and store.calls < 10
    assert called(G.Ledger(10.0, None), store, [(7, 1, 9999, 1.0), (7, 2, 10000, 1.0)], ["account", "charge_id", "seq", "amount"]) == [(7, 2, 10000, 13.0, False)]

    store = Store()
    got = called(G.Tasks(60), store, [(str(k), "start", k) for k in range(n)] + [("3", "finish", 40)], ["task", "event", "ms"])
    assert got == [("3", "finished", 40)] and store.calls < 10 and store.timers == {60}
    late = [r for df in G.Tasks.handleExpiredTimer(_of(G.Tasks(60), store), (0,), Clock(66), None) for r in df.itertuples(index=False, name=None)]
    assert sorted(late) == [(str(k), "timeout", k + 60) for k in (0, 1, 2, 4, 5)] and store.timers == {60, 66}

    store, columns = Store(), ["case_id", "stage", "attempt", "event", "seq", "ms"]
    got = called(G.Attempts(60), store, [(k, "a", 1, "begin", k, k) for k in range(n)], columns)
    assert [r[5] for r in got] == ["sent"] * n and store.calls < 10 and store.timers == {60}
    late = [r for df in G.Attempts.handleExpiredTimer(_of(G.Attempts(60), store), (0,), Clock(62), None) for r in df.itertuples(index=False, name=None)]
    assert late == [(k, "a", 1, "timer", k, "ambiguous", None) for k in (0, 1)]
    assert [r[5:] for r in called(G.Attempts(60), store, [(1, "a", 2, "begin", n, n), (9, "a", 1, "response_saved", n + 1, n)], columns)] == [(None, "unfinished: a/1=ambiguous"), ("response_saved", None)]


def _of(processor, store):
    processor.init(store)
    return processor


def test_a_charge_is_forgotten_after_its_time():
    store, columns = Store(), ["account", "charge_id", "seq", "amount"]
    make = lambda: G.Ledger(100.0, 50)
    assert len(called(make(), store, [(1, 1, 1, 1.0), (2, 1, 2, 1.0)], columns, 10)) == 2 and store.timers == {60}
    assert called(make(), store, [(1, 1, 3, 1.0)], columns, 59) == []
    assert called(make(), store, [(1, 1, 4, 1.0)], columns, 60) == [(1, 1, 4, 2.0, True)]


def test_a_bucket_replays_its_keys_in_one_call():
    import pandas as pd

    from quillon.streaming import journal as J

    class State:
        exists, get, updates = False, None, 0

        def update(self, v):
            self.exists, self.get, self.updates = True, v, self.updates + 1

    state = State()
    go = lambda rows: [r for df in J._replay((0,), iter([pd.DataFrame(rows, columns=["key", "seq", "state"])]), state) for r in df.itertuples(index=False, name=None)]
    assert sorted(go([("a", 2, "sent"), ("b", 3, "sent"), ("a", 1, "pending")])) == [("a", "sent", 2, 0, True), ("b", "sent", 1, 1, True)]
    assert go([("b", 4, "technical_failure")]) == [("b", "technical_failure", 2, 1, False)] and state.updates == 2
