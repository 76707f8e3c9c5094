"""Contributions of trees against all coalitions of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tabulon.operators import models as md, trees as tr

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).round(1)
    y = np.where(x[:, 0] > 0, 3 * x[:, 1], -x[:, 2]) + 2 * (x[:, 1] > x[:, 2]) + 0.1 * rng.normal(size=600)
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")


def expected(at, x, known):
    """Value of a tree when only some features are known."""
    if at.left is None:
        return at.value
    if at.feature in known:
        goes = x[at.feature] in at.categories if at.categories else x[at.feature] <= at.threshold
        return expected(at.left if goes else at.right, x, known)
    return (at.left.rows * expected(at.left, x, known) + at.right.rows * expected(at.right, x, known)) / at.rows


def shapley(trees, x, n):
    value = lambda known: sum(w * expected(root, x, known) for w, root in trees)
    out = []
    for j in range(n):
        others = [i for i in range(n) if i != j]
        out.append(sum(
            factorial(size) * factorial(n - size - 1) / factorial(n) * (value({*s, j}) - value(set(s)))
            for size in range(n) for s in combinations(others, size)
        ))
    return out, value(set())


@pytest.mark.parametrize("trees,depth", [(1, 1), (4, 3), (3, 5)])
def test_contributions_against_all_coalitions(spark, rows, trees, depth):
    model, data = md.fit_gbt(rows, "y", XS, trees=trees, depth=depth)
    counted = tr.counted_trees(model, data, XS)
    got = tr.tree_contributions(model, model.transform(data), XS, data).orderBy("id").collect()
    assert len(got) == 600
    for r in got[::17]:
        want, base = shapley(counted, [r[x] for x in XS], 3)
        assert [r[f"{x}_effect"] for x in XS] == pytest.approx(want, abs=1e-9) and r["base"] == pytest.approx(base)
        assert sum(want) + base == pytest.approx(r["prediction"])


def test_one_tree_category_and_missing_values(spark, rows):
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.sql import functions as F

    df = rows.withColumn("c", F.pmod("id", F.lit(5)).cast("double")).withColumn("y", F.col("y") + F.when(F.col("c").isin(1.0, 4.0), 5.0).otherwise(0.0))
    data = VectorAssembler(inputCols=XS, outputCol="v").transform(df)
    data = VectorIndexer(inputCol="v", outputCol="features", maxCategories=6).fit(data).transform(data)
    model = DecisionTreeRegressor(labelCol="y", maxDepth=4).fit(data)
    counted = tr.counted_trees(model, data, XS)
    assert any(n.categories for n in _inner(counted[0][1]))
    more = spark.createDataFrame([(-1, None, 1.0, 2.0, 0.0)], df.schema)
    got = tr.tree_contributions(model, df.unionByName(more), XS, data).collect()
    for r in got:
        if r["id"] < 0:
            assert r["a_effect"] is None and r["b_effect"] is None
        elif r["id"] % 29 == 0:
            want, base = shapley(counted, [r[x] for x in XS], 3)
            assert [r[f"{x}_effect"] for x in XS] == pytest.approx(want, abs=1e-9)


def _inner(at):
    return [] if at.left is None else [at, *_inner(at.left), *_inner(at.right)]
