"""Sketches, table functions, fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import tables
from quillon.operators import lineage, sketches


@pytest.mark.parametrize("n", [0, 1, 500, 60_000])
def test_sketches_count_and_unite(spark, n):
    rows = spark.range(2 * n).select((F.col("id") % 3).alias("k"), (F.col("id") % max(1, n)).alias("v"), (F.col("id") % 7).alias("part"))
    kept = sketches.sketched(rows, ["k", "part"], "v")
    united = {r.k: (r.approx, r.rows) for r in sketches.counted(sketches.united(kept, ["k"])).collect()}
    whole = {r.k: (r.approx, r.rows) for r in sketches.counted(sketches.sketched(rows, ["k"], "v")).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    assert united.keys() == whole.keys() == exact.keys()
    for k, want in exact.items():
        assert united[k][1] == whole[k][1] and abs(united[k][0] - want) <= 0.03 * want and abs(whole[k][0] - want) <= 0.03 * want


def test_two_halves_unite_to_the_whole(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("v"))
    half = [sketches.sketched(rows.where(f"v % 2 {c} 0"), ["k"], "v") for c in ("=", "<>")]
    both = sketches.counted(sketches.united(half[0].unionByName(half[1]), ["k"])).first().approx
    assert abs(both - 40_000) < 0.03 * 40_000
    assert abs(both - sketches.counted(sketches.sketched(rows, ["k"], "v")).first().approx) <= 0.01 * 40_000
    nothing = sketches.counted(sketches.sketched(rows.withColumn("v", F.lit(None).cast("long")), ["k"], "v")).first()
    assert (nothing.approx, nothing.rows) == (0, 40_000)


def test_table_function_equals_its_columns(spark):
    rng = random.Random(3)
    rows = [(i, [(float(a := rng.randint(0, 9)), a + rng.choice([-1.0, 0.0, 0.5, 1.0, 6.0, 7.3])) for _ in range(rng.randint(0, 4))]) for i in range(200)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, f"id long, spans {tables.SPANS}")
    df.createOrReplaceTempView("spans_of_test")
    tables.register(spark)
    for step, most in ((2.0, 5), (0.5, 100), (10.0, 1)):
        got = spark.sql(f"SELECT id, span, moment FROM spans_of_test, LATERAL visual_inspect(spans, {step}D, {most})").collect()
        want = tables.moments(df, ["id"], F.col("spans"), step, most).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
        assert all(len({r.moment for r in got if r.id == i}) == sum(r.id == i for r in got) <= most for i in range(20))


def test_fingerprints_follow_rows_fields_and_parts(spark):
    df = spark.range(3_000).select("id", (F.col("id") * 2).alias("v"))
    of = lambda x, **k: lineage.table_fingerprint(x, "id", F.col("v").cast("string"), **k).first()
    a = of(df, model="m")
    assert a == of(df.repartition(5), model="m") and a.rows == 3_000
    for other in (of(df, model="n"), of(df.where("id < 2999"), model="m"), of(df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), model="m"), of(df.withColumn("w", F.lit(1)), model="m")):
        assert other.run != a.run
    empty = of(df.where("false"))
    assert (empty.rows, empty.content) == (0, None) and len(empty.run) == 64
