"""Perceptron updates against a row-by-row version, gradients against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import gradient as gd


def test_a_pass_is_row_by_row():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300, 900):
        x = np.column_stack([rng.normal(size=(n, 3)), np.ones(n)])
        y = np.where(x @ [1, -2, 0.5, 0.1] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
        w, mistakes = np.zeros(4), 0
        for a, b in zip(x, y):
            if b * (w * a).sum() <= 0:
                w, mistakes = w + b * a, mistakes + 1
        got, wrong = gd.one_pass(np.zeros(4), x, y)
        assert np.allclose(got, w) and wrong == mistakes


@pytest.mark.parametrize("tasks", [1, 5])
def test_separable_rows_end_without_mistakes(spark, tasks):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    x = x[np.abs(x @ [2, -1] - 0.5) > 0.3]
    rows = [(*map(float, r), int(np.sign(r @ [2, -1] - 0.5))) for r in x] + [(None, 1.0, 1), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, side int").repartition(tasks)
    fit = gd.fit_perceptron(df, "side", ["a", "b"], 200)
    assert fit.separates and 1 < fit.rounds < 200
    assert df.filter(fit.side(["a", "b"]) != F.col("side")).count() == 0
    mixed = df.unionByName(spark.createDataFrame([(0.1, 0.1, 1), (0.1, 0.1, -1)], df.schema))
    assert (lambda f: not f.separates and f.rounds == 4)(gd.fit_perceptron(mixed, "side", ["a", "b"], 4))
    assert gd.fit_perceptron(df.limit(0), "side", ["a", "b"]).separates


@pytest.mark.parametrize("sizes", [[3, 4], [5, 7, 3], [4, 6, 5, 2]])
def test_gradient_against_finite_differences(sizes):
    rng = np.random.default_rng(len(sizes))
    model = gd.Layers.start(sizes, 2)
    x, y = rng.normal(size=(11, sizes[0])), rng.integers(0, sizes[-1], 11)
    loss, slope = model.gradient(x, y)
    at = model.flat()
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-6
        up, down = (model.like(at + s).gradient(x, y)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("batch", [1.0, 0.5])
def test_layers_learn_what_no_plane_can(spark, batch):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(900, None, 1), (901, [1.0, None], 1), (902, [1.0, 1.0], 7)], "id int, v array<double>, c int").repartition(3)
    fit = gd.fit_layers(df, "c", "v", [2, 16, 2], ["id"], steps=60, batch=batch, rate=0.05)
    rows = {r["id"]: r for r in fit.predict(df, "v").collect()}
    assert np.mean([rows[i]["prediction"] == y[i] for i in range(400)]) > 0.93 and fit.losses[-1] < fit.losses[0] / 2
    assert rows[900]["prediction"] is None and rows[901]["probability"] is None and len(rows) == 403
