"""Cases that the test tables do not hold: far values, missing values, ties, zeros, text arms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars as sc, tails
from tabulon.operators import bandit as bd, charts as ch, joins as jn, models as md, recommend as rc, rows as rw, stats as st
from tabulon.plans import ordered


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_group_slopes_far_from_zero(spark, far):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    rows = [("g", far + float(a), 3.0 * float(a) + 5.0) for a in x] + [("one", 2.0, 7.0), ("flat", 1.0, 1.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fits = {r["g"]: r for r in md.fit_per_group(df, "g", "y", ["x"]).collect()}
    assert fits["g"]["weights"][0] == pytest.approx(3.0, rel=1e-6)
    # Groups that cannot tell a slope have none.
    assert fits["one"]["weights"] == [0.0] and fits["one"]["intercept"] == 7.0
    assert fits["flat"]["weights"] == [0.0] and fits["flat"]["intercept"] == 2.0
    ridge = {r["g"]: r for r in md.ridge_per_group(df, "g", "y", ["x"], 0.01).collect()}
    assert ridge["g"]["weights"][0] == pytest.approx(3.0, rel=1e-4)


def test_digitize_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(sc.digitize("x", [0, 1, 2, 3])).collect()] == [None, 1, 1, 3]


def test_bins_of_one_value(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    assert [(r["bin"], r["n"]) for r in ch.histogram(df, "x", 10).collect()] == [(0, 2)]


def test_divergence_from_zero(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0), (0.0, 0.0)], "p double, q double")
    assert st.kl(df, "p", "q").first()[0] == math.inf
    assert st.kl(df.filter("q > 0"), "p", "q").first()[0] == pytest.approx(0.5 * math.log(0.5))


def test_density_beside_an_outlier(spark):
    rng = np.random.default_rng(0)
    values = [*map(float, rng.normal(size=500)), 5000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ch.kde(df, "x", 5001, bandwidth=0.3).filter("x between -4 and 4").collect()
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - np.array(values)) / 0.3) ** 2).sum() / (501 * 0.3 * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=0.02, abs=1e-4)
    assert max(r["density"] for r in got) > 0.3
    exact = ch.kde(df, "x", 5001, bandwidth=0.3, per_width=None).filter("x between -4 and 4").collect()
    assert sum(r["density"] for r in exact) == pytest.approx(sum(r["density"] for r in got), rel=1e-3)


def test_lookup_with_a_repeated_key(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, sc.map_lookup(df, dim, "k", "k", "v").collect()), key=str) == [(1, "a"), (2, None), (None, None)]


def test_side_by_side_keeps_the_longer(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "a long"), spark.createDataFrame([(9,)], "b long")
    got = jn.zip_rows(a, b, ["a"], ["b"]).orderBy("row_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 9), (2, None), (3, None)]


def test_text_arms(spark):
    rows = [(i, "b" if i % 2 else "a", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "i long, arm string, click int")
    assert bd.greedy_arm(df, "arm", "click", ["i"], 6).first()["arm"] == "a"
    scored = bd.ucb1(bd.arm_stats(df, "arm", "click"), "arm").collect()
    assert {r["arm"]: r["chosen"] for r in scored} == {"a": True, "b": False}


def test_posterior_draws_do_not_depend_on_partitions(spark):
    post = spark.createDataFrame([("a", 30, 70), ("b", 40, 60)], "arm string, alpha long, beta long")
    got = {r["arm"]: r["win_share"] for r in bd.thompson_draws(post, "arm", 25_000, 3).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and 0.9 < got["b"] < 0.96


@pytest.mark.parametrize("dof", [1e7, 1e13])
def test_tails_with_many_degrees(dof):
    assert tails.t_ppf(0.975, dof) == pytest.approx(1.959964, abs=1e-5)
    assert tails.t_sf(0.5, dof) == pytest.approx(0.308538, abs=1e-5)
    assert tails.f_sf(2.0, 4, dof) == pytest.approx(tails.chi2_sf(8.0, 4), abs=1e-6)
    assert tails.chi2_sf(dof, dof) == pytest.approx(0.5, abs=1e-3)


def test_tails_meet_at_the_limit():
    assert tails.t_sf(1.3, 0.99e6) == pytest.approx(tails.t_sf(1.3, 1.01e6), rel=1e-5)
    assert tails.f_sf(1.7, 6, 0.99e6) == pytest.approx(tails.f_sf(1.7, 6, 1.01e6), rel=1e-4)


def test_large_samples_and_ranks_are_numbered(spark, monkeypatch):
    df = spark.range(3000).withColumn("g", F.col("id") % 2)
    small = {r["id"] for r in rw.sample_n(df, 500, 3, ["id"]).collect()}
    monkeypatch.setattr(rw, "SMALL_SAMPLE", 10)
    assert {r["id"] for r in rw.sample_n(df, 500, 3, ["id"]).collect()} == small
    top = {r["id"] for r in ordered.first_per_group(df, ["g"], ["id"], 1200).collect()}
    assert top == set(range(2400))


def test_lists_keep_context_over_borders(spark):
    rows = [(b, i, f"{b}-{i}") for b, n in ((1, 11), (2, 3), (3, 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "b long, i long, item string")
    near = set()
    for r in rc.embedding_lists(df, "b", "item", ["i"], window=2, list_items=4).collect():
        w = r["words"]
        near |= {(x, y) for p, x in enumerate(w) for y in w[max(0, p - 2) : p + 3] if x != y}
    want = {(f"{b}-{i}", f"{b}-{j}") for b, n in ((1, 11), (2, 3), (3, 8)) for i in range(n) for j in range(n) if i != j and abs(i - j) <= 2}
    assert near == want


def test_folds_go_by_key(spark):
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(2 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "id long, x double, y double")
    est = LinearRegression(labelCol="y")
    runs = [md.grid_search(est, md.assemble(d, ["x"]), {"regParam": [0.0, 5.0]}, "y", ["id"]).collect() for d in (df, df.repartition(7))]
    assert [r["regParam"] for r in runs[0]] == [0.0, 5.0]
    assert runs[0][0]["rmse"] == pytest.approx(runs[1][0]["rmse"], rel=1e-9)


def _unbalanced(spark, n=240, scale=1.0):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        e, t = int(rng.integers(0, 12)), int(rng.integers(0, 8))
        x = float(rng.normal() + 0.3 * e - 0.2 * t)
        rows.append((e, t, x, scale * (1.5 * x + e - 0.5 * t + float(rng.normal()))))
    return spark.createDataFrame(rows, "e long, t long, x double, y double")


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_two_way_errors_on_both_sides_of_the_switch(spark, monkeypatch, scale):
    from tabulon.operators import causal as cs

    df = _unbalanced(spark, scale=scale)
    dummies = cs.clustered(df, "y", ["x"], "e", "t").first(), cs.fixed_effects(df, "y", ["x"], "e", "t")
    monkeypatch.setattr(cs, "TIME_DUMMIES", 2)
    means = cs.clustered(df, "y", ["x"], "e", "t").first(), cs.fixed_effects(df, "y", ["x"], "e", "t")
    assert means[0]["coef"] == pytest.approx(dummies[0]["coef"], rel=1e-6) and means[0]["se"] == pytest.approx(dummies[0]["se"], rel=1e-6)
    assert means[1].names == dummies[1].names == ["x"] and means[1].dof == dummies[1].dof
    assert means[1].r2 == pytest.approx(dummies[1].r2, rel=1e-6) and means[1].se[0] == pytest.approx(dummies[1].se[0], rel=1e-6)


def test_two_way_means_that_do_not_settle(spark, monkeypatch):
    from tabulon.operators import causal as cs

    monkeypatch.setattr(cs, "TIME_DUMMIES", 2)
    monkeypatch.setattr(cs, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        cs.fixed_effects(_unbalanced(spark), "y", ["x"], "e", "t")


def test_rules_of_a_large_set(spark):
    from tabulon.operators import baskets as bk

    # One basket type of 32 items: 2^32 splits, but one left side is rare enough to pass.
    items = [f"i{k:02d}" for k in range(32)]
    sets = [(items, 2, 0.02), ([items[0]], 2, 0.02), (items[1:], 100, 1.0), *[([i], 100, 1.0) for i in items[1:]]]
    df = spark.createDataFrame(sets, "items array<string>, freq long, support double")
    got = bk.rules(df, 0.5).collect()
    assert [(r["antecedents"], r["confidence"]) for r in got] == []
    low = bk.rules(df, 0.01).collect()
    assert {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in low} == {(tuple(items[1:]), (items[0],))}


def test_rules_level_by_level_equal_all_splits(spark):
    from itertools import combinations

    from tabulon.operators import baskets as bk

    rng = np.random.default_rng(5)
    baskets = [set(rng.choice(list("abcde"), rng.integers(1, 6), replace=False)) for _ in range(60)]
    freq = {c: n for k in range(1, 6) for c in combinations("abcde", k) if (n := sum(set(c) <= b for b in baskets))}
    df = spark.createDataFrame([(list(c), n, n / 60) for c, n in freq.items()], "items array<string>, freq long, support double")
    for level in (0.0, 0.4, 0.7):
        want = {
            (left, tuple(x for x in c if x not in left))
            for c, n in freq.items() if len(c) > 1 for k in range(1, len(c)) for left in combinations(c, k) if n / freq[left] >= level
        }
        got = [(tuple(r["antecedents"]), tuple(r["consequents"])) for r in bk.rules(df, level).collect()]
        assert set(got) == want and len(got) == len(want)


def test_decay_search_reports_shares(spark):
    import datetime

    rng = np.random.default_rng(3)
    start, rows = datetime.date(2020, 1, 1), []
    for i in range(300):
        a, b = float(rng.random()), float(rng.random())
        rows.append((start + datetime.timedelta(days=i), a, b, 3 * a + b))
    df = spark.createDataFrame(rows, "day date, a double, b double, y double")
    cuts = datetime.date(2020, 7, 1), datetime.date(2020, 9, 1)
    best = md.search_adstock(df, "y", ["day"], {"a": [0.0, 0.5], "b": [0.0, 0.5]}, [], "day", *cuts).first()
    assert (best["a_rate"], best["b_rate"]) == (0.0, 0.0) and best["valid_rmse"] == pytest.approx(0.0, abs=1e-6)
    a, b = np.array([r[1:3] for r in rows if r[0] < cuts[0]]).T
    effect, spend = np.array([3 * np.abs(a - a.mean()).mean(), np.abs(b - b.mean()).mean()]), np.array([a.sum(), b.sum()])
    assert best["rssd"] == pytest.approx(np.linalg.norm(effect / effect.sum() - spend / spend.sum()), abs=1e-9)
    sizes = md.search_model_size(df, "y", ["day"], {"a": 0.0, "b": 0.0}, [], [(1, 1), (10, 3)], "day", *cuts).collect()
    assert [(r["trees"], r["depth"]) for r in sizes] == [(10, 3), (1, 1)] and sizes[0]["valid_rmse"] < sizes[1]["valid_rmse"]


def test_resampled_interval_is_near_the_normal_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(rng.normal(10, 2, 800))] + [(900, "none", None)], "id long, g string, y double")
    got = {r["g"]: r for r in ch.bootstrap_ci(df, ["g"], "y", ["id"], 300).collect()}
    normal = {r["g"]: r for r in ch.mean_ci(df, ["g"], "y").collect()}
    assert got["g"]["low"] == pytest.approx(normal["g"]["low"], abs=0.05) and got["g"]["high"] == pytest.approx(normal["g"]["high"], abs=0.05)
    assert got["none"]["mean"] is None and got["none"]["low"] is None


def test_batch_tails_equal_single_ones():
    rng = np.random.default_rng(6)
    t, dof = rng.normal(0, 3, 400), np.exp(rng.uniform(0, 16, 400))
    assert tails.t_sf_many(t, dof) == pytest.approx([tails.t_sf(a, b) for a, b in zip(t, dof)], rel=1e-9)
    a, b, x = rng.uniform(0.2, 40, (2, 300)).tolist() + [rng.uniform(-0.1, 1.1, 300)]
    assert tails.betainc_many(np.array(a), np.array(b), x) == pytest.approx([tails.betainc(*r) for r in zip(a, b, x)], rel=1e-9, abs=1e-12)
    assert len(tails.t_sf_many(np.empty(0), np.empty(0))) == 0


def test_expanded_rows_come_in_pieces(spark):
    from tabulon.functions import udfs

    df = spark.createDataFrame([(25_000,), (0,), (3,)], "n long")
    got = udfs.expand_rows(df, lambda r: ((r[0], i) for i in range(r[0])), "n long, i long")
    assert {r["n"]: r["count"] for r in got.groupBy("n").count().collect()} == {25_000: 25_000, 3: 3}
