"""Operators that once refused many levels, groups or arms."""

import numpy as np
import pandas as pd
import pytest

from tabulon.operators import bandit as bd, recommend as rc, stats as st


@pytest.mark.parametrize("cells", [
    {(0, 0): 5, (0, 1): 9, (1, 0): 2, (1, 1): 30}, {(0, 0): 5, (0, 1): 9, (1, 1): 30}, {(0, 0): 8, (1, 1): 3}, {(0, 0): 1, (1, 1): 1},
    {(0, 0): 5, (1, 1): 7, (2, 0): 4, (2, 1): 1}, {(i, i % 3): 3 + i for i in range(9)},
])
def test_chi2_without_absent_cells(spark, cells):
    rows = [k for k, n in cells.items() for _ in range(n)] + [(None, 1), (1, None)]
    r = st.chi2(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    o = pd.Series(cells).unstack(fill_value=0).to_numpy(float)
    e = o.sum(axis=1, keepdims=True) * o.sum(axis=0) / o.sum()
    d = np.abs(o - e)
    dof = (o.shape[0] - 1) * (o.shape[1] - 1)
    assert r["dof"] == dof and r["chi2"] == pytest.approx((((d - np.minimum(0.5, d)) if dof == 1 else d) ** 2 / e).sum(), abs=1e-9)


def test_chi2_of_many_levels(spark):
    """30,000 levels on either side: the grid would have 900 million cells."""
    df = spark.range(60_000).selectExpr("id % 30000 as a", "(id * 7) % 30000 as b")
    r = st.chi2(df, "a", "b").first()
    assert r["dof"] == 29_999**2 and r["chi2"] == pytest.approx(60_000 * (30_000 - 1), rel=1e-9)


def test_tukey_pairs_are_made_in_tasks(spark):
    df = spark.range(60).selectExpr("id % 15 as g", "cast(id * 37 % 101 as double) as x")
    rows = {(r["group1"], r["group2"]): r for r in st.tukey(df, "x", "g").collect()}
    assert set(rows) == {(i, j) for i in range(15) for j in range(i + 1, 15)}
    x = {g: [float(i * 37 % 101) for i in range(60) if i % 15 == g] for g in range(15)}
    mse = sum(np.var(v) * 4 for v in x.values()) / 45
    for (i, j), r in rows.items():
        diff = np.mean(x[j]) - np.mean(x[i])
        assert r["diff"] == pytest.approx(diff) and r["q"] == pytest.approx(abs(diff) / np.sqrt(mse / 4)) and 0 <= r["p"] <= 1
    assert st.tukey(df.filter("g = 1"), "x", "g").count() == 0


def test_draws_of_many_arms(spark, monkeypatch):
    posterior = spark.createDataFrame([(i, 1 + i, 400) for i in range(300)], "arm int, alpha long, beta long")
    whole = {r["arm"]: r["win_share"] for r in bd.thompson_draws(posterior, "arm", 500, 3).collect()}
    monkeypatch.setattr(bd, "DRAWN", 700)
    assert whole == {r["arm"]: r["win_share"] for r in bd.thompson_draws(posterior, "arm", 500, 3).collect()}
    assert len(whole) == 300 and sum(whole.values()) == pytest.approx(1) and whole[299] > whole[100]


def test_embedding_model_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(1, f"i{i}", i) for i in range(50)], "b int, item string, t int")
    monkeypatch.setattr(rc, "MODEL_BYTES", 8 * 10 * 49)
    with pytest.raises(ValueError, match="50 items"):
        rc.item2vec(df, "b", "item", ["t"], size=10)
