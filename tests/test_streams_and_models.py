"""Streams over several micro-batches, readers, and models on data with a known answer."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import udfs
from tabulon.operators import models as md, rows as rw
from tabulon.sources import files
from tabulon.streaming import twins as st

T0 = datetime.datetime(2024, 1, 1)


def stamp(hours):
    return T0 + datetime.timedelta(hours=hours)


def stream_of(spark, tmp_path, *batches):
    """One file per micro-batch, in order."""
    schema = "id long, ts timestamp, k string, v double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = spark.read.parquet(str(tmp_path / "in"))
    return st.read_stream(spark, str(tmp_path / "in"), first.schema, files_per_batch=1)


def test_tumbling_drops_rows_behind_the_watermark(spark, tmp_path):
    sdf = stream_of(
        spark, tmp_path,
        [(1, stamp(1), "a", 1.0), (2, stamp(50), "a", 2.0)],
        [(4, stamp(51), "a", 4.0)],
        [(3, stamp(2), "a", 9.0), (5, stamp(75), "a", 8.0)],
    )
    out = {r["start"]: (r["n"], r["mean"]) for r in st.run_to_table(st.stream_tumbling(sdf, "ts", ["k"], "v"), "t").collect()}
    # A batch filters late rows by the watermark of the batch before it, so the row for day one,
    # two batches after that day was passed, is gone. The last day is still open.
    assert out == {stamp(0): (1, 1.0), stamp(48): (2, 3.0)}


def test_sessions_join_across_batches(spark, tmp_path):
    sdf = stream_of(
        spark, tmp_path,
        [(1, stamp(0), "a", 1.0), (2, stamp(0.25), "a", 1.0)],
        [(3, stamp(0.5), "a", 1.0), (4, stamp(5), "b", 1.0)],
        [(5, stamp(30), "c", 1.0)],
    )
    out = {(r["k"], r["start"]): r["n"] for r in st.run_to_table(st.stream_sessions(sdf, "ts", "k"), "s").collect()}
    assert out == {("a", stamp(0)): 3, ("b", stamp(5)): 1}


def test_running_rate_keeps_counting(spark, tmp_path):
    sdf = stream_of(
        spark, tmp_path,
        [(1, stamp(0), "a", 1.0), (2, stamp(1), "a", 0.0), (3, stamp(1), "b", 1.0)],
        [(4, stamp(2), "a", 1.0)],
    )
    sdf = sdf.withColumn("click", F.col("v").cast("int"))
    out = {r["k"]: (r["shown"], r["clicks"], r["ctr"]) for r in st.run_updates(st.stream_ctr(sdf, "k", "click"), "c", ["k"]).collect()}
    assert out == {"a": (3, 2, pytest.approx(2 / 3)), "b": (1, 1, 1.0)}


def test_dedup_across_batches(spark, tmp_path):
    sdf = stream_of(
        spark, tmp_path,
        [(1, stamp(0), "a", 1.0), (1, stamp(0.1), "a", 2.0)],
        [(1, stamp(0.5), "a", 3.0), (2, stamp(0.6), "a", 4.0)],
    )
    assert sorted(r["id"] for r in st.run_to_table(st.stream_dedup(sdf, "ts", ["id"]), "d").collect()) == [1, 2]


def test_csv_with_schema_reads_dates_and_latin_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "café", "2024-02-03"), (2, "thé", None)], "id long, name string, d string")
    path = files.write_csv(df, str(tmp_path / "x"), sep="|", encoding="ISO-8859-1")
    back = files.read_csv(spark, path, sep="|", schema=df.schema, header=True, dates=["d"], encoding="ISO-8859-1")
    assert sorted((r["id"], r["name"], r["d"]) for r in back.collect())[0] == (1, "café", datetime.datetime(2024, 2, 3))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0), (10, 0), (0, 10)]
    rows = [(i, i % 3, *[float(v) for v in rng.normal(centres[i % 3], 0.5)]) for i in range(240)]
    return spark.createDataFrame(rows, "id int, y int, a double, b double").cache()


def test_classifiers_separate_blobs(blobs):
    data = md.assemble(blobs, ["a", "b"])
    right = lambda d: d.select(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]
    assert right(md.fit_softmax(data, "y").transform(data)) > 0.99
    assert right(md.fit_mlp(data, "y", [2, 6, 3], iterations=80).transform(data)) > 0.95
    two = blobs.filter("y < 2")
    model, seen = md.fit_logistic(two, "y", ["a", "b"])
    assert right(model.transform(seen)) > 0.99
    signed = two.withColumn("side", F.col("y") * 2 - 1)
    model, seen = md.fit_separator(signed, "side", ["a", "b"])
    assert right(model.transform(seen)) > 0.99


def test_clusters_and_components(blobs):
    data = md.assemble(blobs, ["a", "b"])
    _, out = md.kmeans(data, "features", 3)
    assert out.groupBy("y").agg(F.count_distinct("cluster").alias("n")).filter("n > 1").count() == 0
    score = {r["k"]: r["silhouette"] for r in md.silhouette(data, "features", [2, 3, 4]).collect()}
    assert max(score, key=score.get) == 3
    gap = {r["k"]: r["mean_distance"] for r in md.elbow(data, "features", [2, 3]).collect()}
    assert gap[3] < gap[2] / 2
    p = md.pca(data, "features", 2).select("components").collect()
    comp = np.array([r[0] for r in p])
    assert np.allclose(comp.mean(axis=0), 0, atol=1e-9) and abs(np.corrcoef(comp.T)[0, 1]) < 1e-6


def test_trees_and_importance(spark, blobs):
    df = blobs.withColumn("target", F.col("a") * 5 + F.col("id") % 2)
    model, _ = md.fit_gbt(df, "target", ["a", "b"], trees=5, depth=3)
    assert md.importance(model, ["a", "b"], spark).first()["feature"] == "a"
    assert md.permutation_importance(model, df, "target", ["a", "b"], ["id"]).first()["feature"] == "a"
    parts = rw.split(df, {"train": 0.7, "test": 0.3}, 1, ["id"])
    out = md.model_bands(parts.filter("part = 'train'"), parts.filter("part = 'test'"), "target", ["a", "b"], 3, trees=5, depth=3)
    band = {r["band"]: r["m"] for r in out.groupBy("band").agg(F.avg("target").alias("m")).collect()}
    assert set(band) <= {1, 2, 3} and band[1] < band[3]


def test_user_functions(spark, blobs):
    doubled = udfs.map_col(blobs, "a", lambda s: s * 2, "double", "n")
    batched = udfs.map_col(blobs, "a", lambda s: s * 2, "double", "n", batches=True)
    assert doubled.exceptAll(batched).count() == 0
    import pandas as pd

    out = udfs.udaf(
        blobs.repartition(5), ["y"], lambda g: pd.Series({"s": g["a"].sum(), "n": len(g)}), ["s", "n"], {"m": F.col("s") / F.col("n")}
    )
    want = {r["y"]: r["m"] for r in blobs.groupBy("y").agg(F.avg("a").alias("m")).collect()}
    assert {r["y"]: r["m"] for r in out.collect()} == {k: pytest.approx(v) for k, v in want.items()}
