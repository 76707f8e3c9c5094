"""The robust local trend against a plain version."""

import numpy as np
import pytest

from tabulon.operators import lowess as lw


def brute(x, y, share, rounds, anchors):
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], len(x)
    values = np.unique(x)
    at = values if len(values) <= anchors else np.unique(x[sorted({round(g * (n - 1) / (anchors - 1)) for g in range(anchors)})])
    h = np.array([np.sort(np.abs(x - a))[int(np.ceil(share * n)) - 1] for a in at])
    w = np.ones(n)
    for k in range(rounds + 1):
        trend = []
        for a, b in zip(at, h):
            v = w * (np.clip(1 - (np.abs(x - a) / b) ** 3, 0, None) ** 3 if b > 0 else (x == a))
            xm, ym = np.average(x, weights=v), np.average(y, weights=v)
            sxx = (v * (x - xm) ** 2).sum()
            trend.append(ym + ((v * (x - xm) * (y - ym)).sum() / sxx * (a - xm) if sxx > 1e-10 else 0))
        if k < rounds:
            r = np.abs(y - np.interp(x, at, trend))
            s = np.median(r)
            if s == 0:
                break
            w = np.clip(1 - (r / (6 * s)) ** 2, 0, None) ** 2
    return list(zip(at, trend, h))


@pytest.mark.parametrize("n,digits,share,rounds,anchors,limit", [(400, 6, 0.3, 2, 12, None), (400, 1, 0.5, 3, 200, None), (300, 6, 0.2, 0, 9, 0), (250, 0, 0.4, 2, 40, 0), (60, 2, 1.0, 1, 7, None)])
def test_trend_against_a_plain_version(spark, n, digits, share, rounds, anchors, limit, small_blocks):
    rng = np.random.default_rng(n)
    x = (rng.gamma(2, 2, n)).round(digits)
    y = np.sin(x) + 0.2 * rng.normal(size=n) + (rng.random(n) < 0.05) * 25
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "x double, y double").repartition(3)
    got = [tuple(r) for r in lw.lowess(df, "x", "y", share, rounds, anchors, limit).collect()]
    want = brute(x, y, share, rounds, anchors)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-7)


def test_outliers_do_not_move_the_trend(spark):
    rng = np.random.default_rng(0)
    x = rng.random(2000)
    y = 3 * x + 0.1 * rng.normal(size=2000) + (np.arange(2000) % 11 == 0) * 50
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    robust = lw.lowess(df, "x", "y", 0.4, 3, 10).collect()
    plain = lw.lowess(df, "x", "y", 0.4, 0, 10).collect()
    assert max(abs(r["trend"] - 3 * r["x"]) for r in robust) < 0.1 < 3 < min(r["trend"] - 3 * r["x"] for r in plain)


def test_edges(spark):
    schema = "x double, y double"
    assert lw.lowess(spark.createDataFrame([], schema), "x", "y").count() == 0
    (one,) = lw.lowess(spark.createDataFrame([(2.0, 3.0), (2.0, 5.0)], schema), "x", "y").collect()
    assert tuple(one) == (2.0, 4.0, 0.0)
    line = lw.lowess(spark.createDataFrame([(float(i), 2.0 * i) for i in range(40)], schema), "x", "y", 0.3, 2, 9).collect()
    assert all(r["trend"] == pytest.approx(2 * r["x"], abs=1e-9) for r in line)
