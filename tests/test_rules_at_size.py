"""Queries and their SQL on rows that only larger tables have."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import stats

from .oracle import check


def both(spark, name, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}/*.parquet'")
    found = entry.queries()[name](spark, str(folder))
    return check(found, con.sql(entry.oracle_sql()[name]).df()), found


def test_sql_folds_and_trims_as_the_ladder_does(spark, tmp_path):
    texts = ["ein STRASSENNAME GROSS", "ein straßenname groß", "Straßenname, groß\n", "why!? no", "fuß\tweg", None]
    phrases = ["Straßenname groß\n", " straßenname ", "!?", "FUSS", None, "ö"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n, found = both(spark, "phrase_ladder", tmp_path)
    assert n == 14 and {r.doc_id for r in found.where("item_id = 1").collect()} == {0, 1, 2}


def test_planned_questions_are_never_ones_that_were_run(spark, tmp_path):
    rows = [(3 * 900_000 + k, "F", float(k), "1-URGENT", 1) for k in range(60)]
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_custkey long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    _, found = both(spark, "rate_fixed_denominator", tmp_path)
    assert found.first().population == 20 + 100


@pytest.mark.parametrize("b, c, p", [(300_000, 301_000, 0.1974), (300_000, 300_000, 1.0), (0, 3, 0.25), (0, 0, 1.0)])
def test_mcnemar_takes_steps_in_proportion(spark, b, c, p):
    own = spark.createDataFrame([(b, c)], "b long, c long").select(stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p"))
    assert own.first().p == pytest.approx(p, abs=1e-3) and "array(" not in own._jdf.queryExecution().analyzed().toString().lower()
