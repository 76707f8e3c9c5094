"""Arrow files against what Arrow itself reads and writes."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import feather, ipc
from pyspark.sql import functions as F

from tabulon.sources import arrow_files as af


@pytest.fixture
def table():
    n = 5_000
    rng = np.random.default_rng(0)
    return pa.table({
        "id": pa.array(range(n), pa.int64()), "x": rng.normal(size=n), "name": pa.array([None if i % 7 == 0 else f"é{i % 13}" for i in range(n)]),
        "kind": pa.array([f"k{i % 3}" for i in range(n)]).dictionary_encode(), "u": pa.array([i % 200 for i in range(n)], pa.uint8()),
        "parts": pa.array([list(range(i % 4)) for i in range(n)], pa.list_(pa.int32())), "big": pa.array(["t"] * n, pa.large_string()),
        "day": pa.array([pd.Timestamp("2020-01-01") + pd.Timedelta(hours=i) for i in range(n)], pa.timestamp("ns")),
    })


def write_batches(table, path, rows):
    with ipc.new_file(str(path), table.schema) as out:
        out.write_table(table, max_chunksize=rows)


def test_reads_what_arrow_writes(spark, table, tmp_path):
    write_batches(table, tmp_path / "one.arrow", 300)
    feather.write_feather(table, str(tmp_path / "two.feather"), compression="zstd")
    (tmp_path / "_hidden.arrow").write_bytes(b"no arrow file")
    df = af.read_arrow(spark, str(tmp_path))
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("name", "string"), ("kind", "string"), ("u", "smallint"), ("parts", "array<int>"), ("big", "string"), ("day", "timestamp")]
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    want = table.to_pylist()
    for k, r in enumerate(rows):
        w = want[k // 2]
        assert r == (w["id"], w["x"], w["name"], w["kind"], w["u"], w["parts"], w["big"], w["day"].to_pydatetime())


def test_only_chosen_columns_are_read(spark, table, tmp_path, capsys):
    write_batches(table, tmp_path / "one.arrow", 300)
    df = af.read_arrow(spark, f"file://{tmp_path}/one.arrow", ["name", "id"])
    assert df.columns == ["name", "id"]
    df.explain()
    plan = capsys.readouterr().out
    assert "name#" in plan and "id#" in plan and "parts" not in plan and "kind" not in plan
    assert df.agg(F.sum("id")).first()[0] == sum(range(5_000))
    reader = af.ArrowFileReader(str(tmp_path), df.schema, 1 << 20)
    assert next(reader.read(af.BatchRange(f"{tmp_path}/one.arrow", 0, 1))).schema.names == ["name", "id"]
    with pytest.raises(Exception, match="no column"):
        af.read_arrow(spark, str(tmp_path), ["none"]).collect()


def test_partitions_are_ranges_of_batches(spark, table, tmp_path):
    write_batches(table, tmp_path / "one.arrow", 100)
    size = os.path.getsize(tmp_path / "one.arrow")
    parts = af.ArrowFileReader(str(tmp_path), af.spark_schema(table.schema), size // 5).partitions()
    assert [(p.first, p.last) for p in parts] == [(a, a + 10) for a in range(0, 50, 10)]
    df = af.read_arrow(spark, str(tmp_path), partition_bytes=size // 5)
    assert df.rdd.getNumPartitions() == 5 and df.agg(F.count("*"), F.sum("u")).first() == (5_000, sum(i % 200 for i in range(5_000)))


def test_round_trip_and_modes(spark, table, tmp_path):
    path = str(tmp_path / "out")
    src = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.array("id").alias("a"), F.struct("id").alias("t")).repartition(3)
    af.write_arrow(src, path)
    assert sorted(af.read_arrow(spark, path).collect()) == sorted(src.collect())
    # Arrow itself reads the files, and nothing else is in the folder.
    names = os.listdir(path)
    assert len(names) == 3 and sum(feather.read_table(f"{path}/{n}").num_rows for n in names) == 1000
    with pytest.raises(FileExistsError):
        af.write_arrow(src, path)
    af.write_arrow(src.limit(5), path, "append", "none")
    assert af.read_arrow(spark, path).count() == 1005
    af.write_arrow(src.filter("id < 0"), path, "overwrite")
    empty = af.read_arrow(spark, path)
    assert empty.dtypes == src.dtypes and empty.count() == 0


def test_columns_that_some_files_lack(spark, tmp_path):
    feather.write_feather(pa.table({"a": [1, 2], "b": ["x", "y"]}), str(tmp_path / "1.feather"))
    feather.write_feather(pa.table({"c": [9.5], "a": [3]}), str(tmp_path / "2.feather"))
    assert sorted(map(tuple, af.read_arrow(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(Exception, match="no Arrow file"):
        os.mkdir(tmp_path / "none")
        af.read_arrow(spark, str(tmp_path / "none")).collect()


def test_lost_attempts_leave_no_file(spark, tmp_path):
    """A task that fails half way: the job aborts, and the table is as it was."""
    path = str(tmp_path / "out")
    af.write_arrow(spark.range(10), path)

    def broken(batches):
        for k, b in enumerate(batches):
            if k:
                raise RuntimeError("lost")
            yield b

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        with pytest.raises(Exception, match="lost"):
            af.write_arrow(spark.range(0, 1000, 1, 2).mapInArrow(broken, "id long"), path, "append")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([n for n in os.listdir(path) if not n.startswith("_staging")]) and af.read_arrow(spark, path).count() == 10
    # A second attempt of a task whose first one was lost: only the attempt that reports is taken.
    writer = af.ArrowFileWriter(path, spark.range(1).schema, False, None)
    batch = pa.record_batch([pa.array([1, 2, 3], pa.int64())], ["id"])
    writer.write(iter([batch]))
    done = writer.write(iter([batch, batch]))
    writer.commit([done, None])
    assert af.read_arrow(spark, path).count() == 16 and not [n for n in os.listdir(path) if writer.job in n]
