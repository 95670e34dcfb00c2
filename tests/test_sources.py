"""Sources: the order of filed rows."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.jobs import tables
from ledgerloom.operators import facts as fact_ops
from ledgerloom.sources.ordered import numbered


def append(spark, folder, rows, times=None):
    spark.createDataFrame(rows, "id long, v string").repartition(3).write.mode("append").parquet(f"file://{folder}")


def test_rows_are_numbered_over_appends(spark, tmp_path):
    folder = tmp_path / "t"
    append(spark, folder, [(i, "a") for i in range(100)])
    time.sleep(1.1)
    append(spark, folder, [(i, "b") for i in range(100)])
    got = numbered(spark.read.parquet(f"file://{folder}"), "n").collect()
    assert sorted(r.n for r in got) == list(range(200))
    assert max(r.n for r in got if r.v == "a") < min(r.n for r in got if r.v == "b")
    first = {r.id: r.v for r in numbered(spark.read.parquet(f"file://{folder}"), "n").groupBy("id").agg(F.min_by("v", "n").alias("v")).collect()}
    assert set(first.values()) == {"a"} and len(first) == 100
    again = fact_ops.duplicate_rank(numbered(spark.read.parquet(f"file://{folder}"), "n"), ["id"], "n").collect()
    assert all((r.duplicate_rank == 1) == (r.v == "a") for r in again)


def test_any_part_number_and_one_file(spark, tmp_path):
    folder = tmp_path / "t"
    os.makedirs(folder)
    for k, name in enumerate(("part-100000-x-c999.snappy.parquet", "part-00001-y.parquet", "other.parquet")):
        spark.createDataFrame([(k * 10 + i, "a") for i in range(4)], "id long, v string").coalesce(1).write.parquet(f"file://{tmp_path}/one{k}")
        (part,) = [f for f in os.listdir(tmp_path / f"one{k}") if f.endswith(".parquet")]
        shutil.copy(tmp_path / f"one{k}" / part, folder / name)
        os.utime(folder / name, (1_700_000_000 + k, 1_700_000_000 + k))
    got = {r.id: r.n for r in numbered(spark.read.parquet(f"file://{folder}"), "n").collect()}
    assert got == {k * 10 + i: k * 4 + i for k in range(3) for i in range(4)}
    one = {r.id: r.n for r in numbered(spark.read.parquet(f"file://{folder}/other.parquet"), "n").collect()}
    assert one == {20 + i: i for i in range(4)}


def test_facts_are_keyed_over_appends(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(300)
    for _ in range(2):
        lines.repartition(2).write.mode("append").parquet(f"file://{tmp_path}/lineitem.parquet")
    rows = tables.facts(spark, f"file://{tmp_path}")
    assert rows.count() == rows.select("seq").distinct().count() == 2400


class Settings:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_a_cluster_must_name_a_shared_folder():
    assert tables.shared_folder(Settings(spark_checkpoint_dir="hdfs://x/y/", spark_master="spark://m"), "t").startswith("hdfs://x/y/t-")
    assert tables.shared_folder(Settings(spark_master="local[2]"), "t").startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Settings(spark_master="spark://m"), "t")
