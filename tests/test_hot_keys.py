"""The plans for hot keys give the same rows as plain windows.

One group holds about half of all rows, blocks are seven rows long and the size limit is zero, so
every group is split over many blocks.
"""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregates as ag, joins as jn, relational as rel, windows as wn
from tabulon.plans import ordered
from tabulon.plans.quantiles import quantile_table

pytestmark = pytest.mark.usefixtures("small_blocks")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randrange(12), None if rng.random() < 0.2 else float(rng.randrange(30))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k string, c int, v double").repartition(3).cache()


def same(a, b):
    rows = lambda d: sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*sorted(d.columns)).collect()), key=repr
    )
    left, right = rows(a), rows(b)
    assert len(left) == len(right) and left == right


@pytest.mark.parametrize(
    "op",
    [
        lambda d, g: ordered.with_position(d, ["k"], ["id"], group_rows=g),
        lambda d, g: wn.with_row_id(d, [F.col("c").desc(), "id"], group_rows=g),
        lambda d, g: wn.shift(d, "v", 2, ["id"], ["k"], group_rows=g),
        lambda d, g: wn.shift(d, "v", -9, ["id"], ["k"], group_rows=g),
        lambda d, g: wn.rolling(d, "v", 4, ["id"], ["k"], ["avg", "min", "max", "sum"], 2, group_rows=g),
        lambda d, g: wn.rolling(d, "v", 16, ["id"], [], ["avg"], group_rows=g),
        lambda d, g: wn.expanding(d, "v", ["id"], ["k"], "nxt", group_rows=g),
        lambda d, g: wn.seasonal(d, 3, ["v"], ["id"], ["k"], group_rows=g),
        lambda d, g: wn.dense_rank(d, ["k"], "v", group_rows=g),
        lambda d, g: wn.avg_rank(d, ["k"], "v", group_rows=g),
        lambda d, g: wn.factorize_in_group(d, ["k"], "c", "id", group_rows=g),
        lambda d, g: wn.adstock(d, {"v": 0.7, "c": 0.0}, ["id"], ["k"], group_rows=g),
        lambda d, g: wn.adstock(d, {"v": 1.0}, ["id"], ["k"], group_rows=g),
        lambda d, g: wn.peaks(d, "v", ["id"], ["k"], group_rows=g),
        lambda d, g: wn.sign_changes(d, "v", ["id"], ["k"], group_rows=g),
        lambda d, g: wn.running_rate(d.withColumn("f", (F.col("c") > 5).cast("int")), "f", ["id"], ["k"], group_rows=g),
        lambda d, g: wn.acf(d, "c", 4, ["id"], group_rows=g),
        lambda d, g: rel.backfill(d, ["v"], ["id"], ["k"], group_rows=g),
        lambda d, g: jn.context_pairs(d, "k", "c", ["id"], 3, group_rows=g),
        lambda d, g: ag.collect_ordered(d, ["k"], "c", ["id"], 5, group_rows=g),
        lambda d, g: ag.collect_groups(d, ["k"], "c", 4, group_rows=g),
    ],
)
def test_same_rows(table, op):
    same(op(table, None), op(table, 0))


def test_quantiles_from_counts(table):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    same(
        quantile_table(table, ["v", "c"], probs, ["k"]),
        quantile_table(table, ["v", "c"], probs, ["k"], distinct_values=0, group_rows=0),
    )


def test_running_minimum_starts_with_gap(spark):
    df = spark.createDataFrame([(i, None if i < 15 else float(40 - i)) for i in range(40)], "id int, v double")
    measures = {"lo": ("min", "v"), "hi": ("max", "v"), "s": ("sum", "v"), "n": ("count", "v")}
    same(ordered.running(df, [], ["id"], measures), ordered.running(df, [], ["id"], measures, group_rows=0))


def test_adstock_over_many_carry_blocks(spark):
    """Blocks are at most seven rows long, so slow decay passes through several levels of blocks."""
    rates = {"a": 1e-60, "b": 0.05, "c": 0.5, "d": 0.99, "e": 0.9999}
    rows = [(i, *[float(i % 5)] * 5) for i in range(50)]
    df = spark.createDataFrame(rows, "t int, a double, b double, c double, d double, e double")
    got = wn.adstock(df, rates, ["t"]).orderBy("t").collect()
    for n, rate in rates.items():
        want, y = [], 0.0
        for r in rows:
            y = r[1] + rate * y
            want.append(y)
        assert [r[f"{n}_adstock"] for r in got] == pytest.approx(want, rel=1e-12)
