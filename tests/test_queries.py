"""Every registered query against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import registry

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


#: Queries that hold every row against a stated set of queries or phrases, whose size is checked before it is broadcast, or against one row of totals.
AGAINST_A_SET = {
    "allocate_quota", "cider_like", "cohen_kappa", "cross_join_query_docs", "dense_beam_b", "hierarchical_gated", "join_gold_posthoc", "coarse_route", "medium_rank", "rank_all_mediums",
    "rerank_fine", "retrieve_bm25", "retrieve_dense", "retrieve_hierarchical", "retrieve_siglip", "retrieve_weighted", "run_fingerprint", "select_by_strategy", "topk_bm25", "topk_bm25_compat", "topk_siglip_second", "topk_weighted_fusion",
}


@pytest.mark.parametrize("name", [n for n, q in registry.QUERIES.items() if q.sql])
def test_equals_sql(spark, con, name):
    q = registry.QUERIES[name]
    found = q.run(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in AGAINST_A_SET
    # no customer shares the last three digits of its number in the smallest table
    assert oracle.check(found, con.sql(q.sql).df()) > 0 or name == "scan_tree_glob"


WITHOUT_SQL = sorted(n for n, q in registry.QUERIES.items() if not q.sql)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    got = registry.QUERIES[name].run(spark, SF)
    assert len(got.columns) >= 2 and got.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_replay_equals_batch(spark):
    batch = registry.QUERIES["journal_replay"].run(spark, SF).toPandas()
    stream = registry.QUERIES["stream_journal_replay"].run(spark, SF).toPandas()
    a = {f"{r.user_id}/{r.attempt}": (r.last_state, r.n_events, r.n_illegal, r.unfinished) for r in batch.itertuples()}
    b = {r.key: (r.last_state, r.n_events, r.n_illegal, r.unfinished) for r in stream.itertuples()}
    assert a == b


def test_bootstrap_covers_the_mean(spark):
    """Of intervals from simulated data about 95 in 100 hold the true mean."""
    import numpy as np

    from quillon.functions import stats

    rng = np.random.default_rng(7)
    held = 0
    for k in range(12):
        x = rng.normal(0.3, 1, 400)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "uid long, diff double")
        r = stats.bootstrap_paired(df, "diff", "uid", 400, k).first()
        held += r.low <= 0.3 <= r.high
        # the width is that of the normal interval
        assert 0.7 < (r.high - r.low) / (2 * 1.96 * x.std() / 20) < 1.3 and r.replicates == 400
    assert held >= 9


def test_tasks_time_out(spark, tmp_path):
    import json
    import time

    from quillon.streaming.journal import with_timeout

    (tmp_path / "in").mkdir()
    write = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"task": t, "event": e}) for t, e in rows))
    write(1, ("a", "start"), ("b", "start"))
    q = with_timeout(spark.readStream.schema("task string, event string").json(str(tmp_path / "in")), 20)
    run = q.writeStream.format("memory").queryName("tasks_of_test").outputMode("update").trigger(processingTime="200 milliseconds").start()

    def seen(task, state, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if spark.table("tasks_of_test").where((F.col("task") == task) & (F.col("state") == state)).count():
                return True
            time.sleep(0.5)
        return False

    try:
        assert seen("b", "running")
        write(2, ("a", "finish"))
        assert seen("a", "finished") and seen("b", "timeout")
        write(3, ("b", "finish"))
        assert not seen("b", "finished", 4) and not seen("a", "timeout", 1)
    finally:
        run.stop()
