"""Array files in ranges, and documents that change all at once."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import arrays
from quillon.sources.documents import write_json_atomic


def test_one_file_is_read_in_many_partitions(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(5_000, 12)).astype(np.float32)
    np.save(tmp_path / "a.npy", x)
    df = arrays.read_arrays(spark, str(tmp_path), part_bytes=20_000)
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).collect()
    assert len(parts) == 13 and max(r.n for r in parts) == 20_000 // 48 and all(r.b - r.a == r.n - 1 for r in parts)
    got = sorted((r.row, r.vec) for r in df.collect())
    np.testing.assert_array_equal(np.array([v for _, v in got]), x.astype(float))
    assert [i for i, _ in got] == list(range(5_000))


@pytest.mark.parametrize("kind", ["f8", "f4", "i8", "i2", "u1", ">f8", "?"])
def test_kinds_orders_and_archives(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 3)) * 50).astype(kind)
    whole = {"c": x, "f": np.asfortranarray(x), "one": x[:, 0], "none": x[:0]}
    for name, v in whole.items():
        np.save(tmp_path / f"{name}.npy", v)
    np.savez(tmp_path / "plain.npz", **whole)
    np.savez_compressed(tmp_path / "packed.npz", **whole)
    (tmp_path / "_hidden.npy").write_bytes(b"junk")
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "d.npy", x[:2])
    got: dict = {}
    for r in arrays.read_arrays(spark, str(tmp_path), part_bytes=1_000).collect():
        got.setdefault((r.file.rsplit("/", 1)[-1], r.member), []).append((r.row, r.vec))
    for file, member, v in [(f"{n}.npy", "", v) for n, v in whole.items()] + [(f, n, v) for f in ("plain.npz", "packed.npz") for n, v in whole.items()] + [("d.npy", "", x[:2])]:
        own = sorted(got.pop((file, member), []))
        assert [i for i, _ in own] == list(range(len(v)))
        assert [vec for _, vec in own] == (v[:, None] if v.ndim == 1 else v).astype(float).tolist()
    assert not got


def test_arrays_that_cannot_be_read(spark, tmp_path):
    assert arrays.read_arrays(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        arrays.read_arrays(spark, str(tmp_path / "none")).count()
    np.save(tmp_path / "deep.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="no array of numbers"):
        arrays.read_arrays(spark, str(tmp_path)).count()


def test_arrays_written_and_read_again(spark, tmp_path):
    df = spark.range(1_000).repartition(3).select(F.array((F.col("id") * 1.0), F.lit(0.5)).alias("vec"))
    arrays.write_arrays(df, str(tmp_path / "x"))
    files = list((tmp_path / "x").iterdir())
    assert len(files) == 3 and sum(len(np.load(f)) for f in files) == 1_000
    assert sorted(r.vec[0] for r in arrays.read_arrays(spark, f"file://{tmp_path}/x").collect()) == list(range(1_000))
    bad = df.unionByName(spark.range(1).select(F.array(F.lit(1.0)).alias("vec"))).coalesce(1)
    with pytest.raises(Exception, match="one size"):
        arrays.write_arrays(bad, str(tmp_path / "x"))
    assert sorted((tmp_path / "x").iterdir()) == sorted(files)


def documents(path):
    return {f.name: json.loads(f.read_text()) for f in path.glob("*") if f.is_file()}


def test_documents_change_all_at_once(spark, tmp_path):
    path = tmp_path / "d"
    rows = spark.createDataFrame([(i, f"v{i}", None) for i in range(20)], "k long, name string, extra double")
    write_json_atomic(rows, str(path), "k")
    assert documents(path) == {f"{i}.json": {"k": i, "name": f"v{i}"} for i in range(20)}
    write_json_atomic(rows.where("k < 5").withColumn("name", F.lit("new")), str(path), "k")
    assert documents(path)["4.json"]["name"] == "new" and documents(path)["5.json"]["name"] == "v5"
    assert not [f for f in path.iterdir() if f.name.startswith("_")]


@pytest.mark.parametrize("fault", ["twice", "null", "slash", "raises"])
def test_a_failed_write_leaves_all_old_documents(spark, tmp_path, fault):
    path = tmp_path / "d"
    rows = spark.createDataFrame([(str(i), "old") for i in range(20)], "k string, name string").repartition(4)
    write_json_atomic(rows, str(path), "k")
    new = rows.withColumn("name", F.lit("new"))
    extra = {"twice": ("7", "other"), "null": (None, "x"), "slash": ("a/b", "x"), "raises": ("9x", "x")}[fault]
    new = new.unionByName(spark.createDataFrame([extra], "k string, name string"))
    if fault == "raises":
        new = new.withColumn("name", F.when(F.col("k") == "9x", F.raise_error(F.lit("stop"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="two documents|no name|stop"):
        write_json_atomic(new, str(path), "k")
    assert documents(path) == {f"{i}.json": {"k": str(i), "name": "old"} for i in range(20)}
    assert not [f for f in path.iterdir() if f.name.startswith("_")]
