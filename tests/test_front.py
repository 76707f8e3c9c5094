"""Fronts against all pairs, searches as tables, and products of many columns."""

import datetime
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import front, models as md
from tabulon.plans import gram


def brute(points):
    return [p for p in points if not any(q[0] <= p[0] and q[1] <= p[1] and (q[0] < p[0] or q[1] < p[1]) for q in points)]


@pytest.mark.parametrize("held,digits", [(100_000, 6), (3, 6), (100_000, 0), (2, 1)])
def test_front_against_all_pairs(spark, monkeypatch, held, digits):
    monkeypatch.setattr(front, "HELD", held)
    rng = np.random.default_rng(digits + held)
    a = rng.normal(size=500).round(digits) * 3
    b = (-a + rng.normal(size=500)).round(digits)
    points = list(zip(a.tolist(), b.tolist()))
    rows = [(i, x, y, "t") for i, (x, y) in enumerate(points)] + [(900, None, -99.0, "t"), (901, -99.0, None, "t"), (902, float("nan"), -99.0, "t")]
    df = spark.createDataFrame(rows, "_row int, a double, `b c` double, _a string").repartition(4)
    got = front.pareto_front(df, "a", "b c")
    assert got.columns == df.columns
    assert sorted((r["a"], r["b c"]) for r in got.collect()) == sorted(brute(points))
    assert front.pareto_front(df.limit(0), "a", "b c").count() == 0


def test_front_of_a_search(spark):
    rng = np.random.default_rng(1)
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(days=i), *map(float, rng.gamma(2, 1, 3)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "day date, a double, b double, c double, y double")
    grid = {c: [0.0, 0.3, 0.6, 0.9] for c in "abc"}
    out = md.search_adstock(df, "y", ["day"], grid, [], "day", datetime.date(2020, 5, 1), datetime.date(2020, 6, 1))
    rows = out.collect()
    assert {(r["a_rate"], r["b_rate"], r["c_rate"]) for r in rows} == set(product(*grid.values())) and len(rows) == 64
    assert [r["valid_rmse"] for r in rows] == sorted(r["valid_rmse"] for r in rows)
    out.createOrReplaceTempView("tried")
    better = "b.valid_rmse <= a.valid_rmse and b.rssd <= a.rssd and (b.valid_rmse < a.valid_rmse or b.rssd < a.rssd)"
    want = spark.sql(f"select * from tried a where not exists (select 1 from tried b where {better})").collect()
    assert sorted(front.pareto_front(out, "valid_rmse", "rssd").collect()) == sorted(want)


def test_a_search_against_separate_fits(spark):
    """Each row of the search is the least-squares fit of its own series."""
    rng = np.random.default_rng(2)
    x, y = rng.gamma(2, 1, (90, 2)), rng.normal(size=90)
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(days=i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "day date, a double, b double, y double")
    out = md.search_adstock(df, "y", ["day"], {"a": [0.2, 0.7], "b": [0.0, 0.5]}, [], "day", start + datetime.timedelta(days=50), start + datetime.timedelta(days=70))
    for r in out.collect():
        carried = x.copy()
        for i in range(1, 90):
            carried[i] += carried[i - 1] * [r["a_rate"], r["b_rate"]]
        design = np.column_stack([np.ones(90), carried])
        beta = np.linalg.lstsq(design[:50], y[:50], rcond=None)[0]
        error = lambda s: np.sqrt(np.mean((y[s] - design[s] @ beta) ** 2))  # noqa: B023, E731
        assert [r["train_rmse"], r["valid_rmse"], r["test_rmse"]] == pytest.approx([error(slice(0, 50)), error(slice(50, 70)), error(slice(70, 90))])
        effect = np.abs(beta[1:]) * np.abs(carried[:50] - carried[:50].mean(axis=0)).mean(axis=0)
        spend = x[:50].sum(axis=0)
        assert r["rssd"] == pytest.approx(np.linalg.norm(effect / effect.sum() - spend / spend.sum()))


def test_a_million_combinations_are_a_table(spark):
    table = md.combinations(spark, {f"c{i}": [k / 10 for k in range(10)] for i in range(6)})
    assert table.count() == 1_000_000 and table.rdd.getNumPartitions() > 1
    assert table.select(*[F.count_distinct(f"c{i}") for i in range(6)]).first() == (10,) * 6
    assert table.distinct().count() == 1_000_000


def test_moments_of_many_columns(spark):
    """120 regressors, whole and in groups, against numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 120)) + 1000
    y = x @ rng.normal(size=120) + rng.normal(size=400)
    schema = ", ".join(f"_x{i} double" for i in range(120)) + ", _y double, part string, who int"
    rows = [(*map(float, r), float(v), "ab"[i % 3 > 0], i % 7) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, schema).repartition(3)
    both = np.column_stack([x, y])
    whole = gram.moments(df, 120, entity="who")
    parts = gram.moments(df, 120, "part", entity="who")
    for got, at in ((whole, np.ones(400, bool)), (parts["a"], np.arange(400) % 3 == 0), (parts["b"], np.arange(400) % 3 > 0)):
        assert got.n == at.sum() and got.entities == 7
        assert np.allclose(got.mean, both[at].mean(axis=0)) and np.allclose(got.cross, at.sum() * np.cov(both[at].T, bias=True), atol=1e-5)
    fit = gram.fit_moments(whole, [f"x{i}" for i in range(120)])
    residual = y - fit.coef[0] - x @ fit.coef[1:]
    assert abs(residual.sum()) < 1e-5 and np.abs((x - x.mean(axis=0)).T @ residual).max() < 1e-6
    core = whole.cross[:120, :120]
    assert np.allclose(fit.core @ core, np.eye(120), atol=1e-8)
