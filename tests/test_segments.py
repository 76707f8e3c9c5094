"""Grown segments against all splits, on an effect that is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import segments as sg


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    n = 4000
    a, b, rt = rng.integers(0, 8, n), rng.normal(size=n).round(3), rng.normal(size=n)
    effect = np.where(a <= 2, 3.0, np.where(b <= 0.4, -1.0, 1.0))
    ry = effect * rt + 0.3 * rng.normal(size=n)
    rows = [(i, int(x), float(y), float(t), float(r)) for i, (x, y, t, r) in enumerate(zip(a, b, rt, ry))]
    rows += [(-1, None, 0.0, 1.0, 1.0), (-2, 1, None, 1.0, 1.0), (-3, 1, 1.0, None, 1.0)]
    return spark.createDataFrame(rows, "id long, a int, b double, _rt double, _ry double"), (a, b, rt, ry)


def brute(x, ty, tt, least):
    """Best threshold over all values of all features, and its gain."""
    fall = lambda m: ty[m].sum() ** 2 / tt[m].sum()
    every = np.ones(len(ty), bool)
    best = None
    for f, (v, cuts) in enumerate(x):
        for c in cuts:
            left = v <= c
            if min(left.sum(), (~left).sum()) >= least:
                gain = fall(left) + fall(~left) - fall(every)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, c
    return best


def test_splits_against_all_splits(pairs):
    df, (a, b, rt, ry) = pairs
    splits = sg.grow(df, ["a", "b"], 2, bins=16, least_rows=30)
    assert [(s.node, s.feature) for s in splits][0] == (1, "a") and splits[0].threshold == 2.0
    cuts = {"a": sg.cut_points(df, "a", 16), "b": sg.cut_points(df, "b", 16)}
    assert cuts["a"] == list(range(7)) and len(cuts["b"]) == 15
    nodes = np.ones(len(a), int)
    for s in splits:
        m = nodes == s.node
        want = brute([(a[m], cuts["a"]), (b[m], cuts["b"])], (rt * ry)[m], (rt * rt)[m], 30)
        assert (s.feature, s.threshold) == ("ab"[want[1]], want[2]) and s.gain == pytest.approx(want[0])
        values = a if s.feature == "a" else b
        nodes = np.where(m, np.where(values <= s.threshold, 2 * nodes, 2 * nodes + 1), nodes)
    got = dict(df.filter("id >= 0").select("id", sg.node_of(splits).alias("n")).collect())
    assert [got[i] for i in range(len(a))] == nodes.tolist()
    assert sg.rule_of(splits, 3) == "a > 2"


def test_nothing_to_split(pairs, spark):
    df, _ = pairs
    assert sg.grow(df.withColumn("a", F.lit(1)), ["a"], 2) == [] and sg.grow(df, ["a", "b"], 2, least_rows=3000) == []
    assert sg.node_of([])._jc.toString() == "1" and sg._leaves([]) == [1]


def test_effects_of_grown_segments(spark):
    rng = np.random.default_rng(5)
    n = 6000
    w, g, t = rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n)
    t = t + w
    y = np.where(g >= 2, 2.0, -1.0) * t + 3 * w + 0.2 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(p), int(q), float(r), float(s)) for i, (p, q, r, s) in enumerate(zip(w, g, t, y))], "id long, w double, g int, t double, y double")
    rows = sg.grown_segments(df, "y", "t", ["w"], ["g"], 1, 4, 1, ["id"]).collect()
    got = {r["rule"]: r for r in rows}
    assert set(got) == {"g <= 1", "g > 1"} and sum(r["n"] for r in rows) < n * 0.55
    # The controls' model is one for both segments, so its error adds noise to a segment's effect, not bias.
    assert got["g <= 1"]["effect"] == pytest.approx(-1, abs=0.2) and got["g > 1"]["effect"] == pytest.approx(2, abs=0.2)
