"""Hand-checked results on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars as sc, tails
from tabulon.operators import aggregates as ag, baskets as bk, causal as cs, features as ft, regression as rg, stats as st, windows as wn


@pytest.fixture(scope="module")
def five_baskets(spark):
    baskets = [["apple", "egg", "milk"], ["apple", "egg"], ["apple", "bread"], ["egg", "apple", "bread"], ["milk"]]
    rows = [(i, x) for i, b in enumerate(baskets) for x in b]
    return spark.createDataFrame(rows, "b long, i string")


def test_rules_on_five_baskets(five_baskets):
    sets = bk.frequent_itemsets(five_baskets, "b", "i", 0.2)
    support = {tuple(r["items"]): r["support"] for r in sets.collect()}
    assert support[("apple", "egg")] == pytest.approx(3 / 5)
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in bk.rules(sets).collect()}
    r = rules[("apple",), ("egg",)]
    assert (r["confidence"], r["lift"]) == (pytest.approx(0.75), pytest.approx(1.25))
    # A three-item set gives rules with two-item consequents too.
    wide = rules[("milk",), ("apple", "egg")]
    assert wide["confidence"] == pytest.approx(0.5)
    assert all(r["confidence"] >= r["support"] - 1e-12 for r in rules.values())


def test_rule_labels_and_graph(five_baskets):
    labelled = bk.label_rules(bk.rules(bk.frequent_itemsets(five_baskets, "b", "i", 0.2)))
    combos = {r["combo"]: r["n"] for r in bk.combo_counts(labelled).collect()}
    assert set(combos) == {"1 - 1", "1 - 2", "2 - 1"} and combos["1 - 2"] == combos["2 - 1"]
    nodes, edges = bk.rule_graph(labelled)
    assert edges.count() == labelled.count()
    assert {r["node"] for r in nodes.collect()} >= {"apple", "egg", "apple + egg"}


def test_rule_grid_matches_direct_count(five_baskets):
    sets = bk.frequent_itemsets(five_baskets, "b", "i", 0.2)
    grid = {(r[0], r[1]): r[2] for r in bk.rule_grid(sets, [0.2, 0.4], [0.3, 0.7]).collect()}
    for (s, c), n in grid.items():
        again = bk.rules(bk.frequent_itemsets(five_baskets, "b", "i", s), c).count()
        assert n == again


def test_segment_rates_turn_round(spark):
    groups = [("H", "heart", 70, 90), ("H", "band", 10, 10), ("N", "heart", 2, 10), ("N", "band", 81, 90)]
    rows = [(d, o, int(k < good)) for d, o, good, n in groups for k in range(n)]
    out = ag.segment_rates(spark.createDataFrame(rows, "doctor string, op string, ok int"), "doctor", "op", "ok").collect()
    rate = {(r["doctor"], r["op"], r["level"]): r["rate"] for r in out}
    assert rate["H", None, "overall"] == pytest.approx(0.80) and rate["N", None, "overall"] == pytest.approx(0.83)
    assert rate["H", "heart", "segment"] == pytest.approx(70 / 90) and rate["N", "heart", "segment"] == pytest.approx(0.2)
    assert rate["H", "band", "segment"] == 1.0 and rate["N", "band", "segment"] == pytest.approx(0.9)


def test_city_shares(spark):
    rows = [(1, "London", 10), (2, "London", 500), (3, "London", 48), (4, "Leeds", 7)]
    df = spark.createDataFrame(rows, "id int, city string, sales long")
    shares = {r["id"]: r["share"] for r in wn.group_total(df, ["city"], "sales").collect()}
    assert shares == {1: pytest.approx(10 / 558), 2: pytest.approx(500 / 558), 3: pytest.approx(48 / 558), 4: 1.0}


def test_robust_scale(spark):
    df = spark.createDataFrame([(10.0, 0.01), (30.0, 0.02), (50.0, 0.05), (110.0, 0.085), (130.0, 0.1)], "a double, b double")
    out = [r["a"] for r in ft.scale_robust(df, ["a", "b"]).collect()]
    assert sorted(out) == pytest.approx(sorted((x - 50) / 80 for x in (10, 30, 50, 110, 130)))


def test_cross_entropy(spark):
    row = spark.range(1).select(
        sc.cross_entropy(F.array(*map(F.lit, (0, 1, 0))), F.array(*map(F.lit, (0.2, 0.7, 0.1)))).alias("a"),
        sc.cross_entropy(F.array(*map(F.lit, (1, 0, 0))), F.array(*map(F.lit, (0.5, 0.3, 0.2)))).alias("b"),
    ).first()
    assert row["a"] + row["b"] == pytest.approx(-math.log(0.7) - math.log(0.5))


def test_rolling_pair_mean(spark):
    df = spark.createDataFrame([(1, 20.7), (2, 17.9), (3, 18.8), (4, 14.6)], "t int, v double")
    out = {r["t"]: r["v_avg2"] for r in wn.rolling(df, "v", 2, ["t"], shift=1).collect()}
    assert out[1] is None and out[2] is None
    assert out[3] == pytest.approx(19.30) and out[4] == pytest.approx(18.35)


def test_sine_peaks(spark):
    x = np.linspace(0, 50, 1000)
    df = spark.createDataFrame([(i, float(0.75 * math.sin(v))) for i, v in enumerate(x)], "t int, y double")
    kinds = [r["turn"] for r in wn.peaks(df, "y", ["t"]).collect()]
    assert (kinds.count("peak"), kinds.count("valley")) == (8, 8)
    assert wn.sign_changes(df, "y", ["t"]).count() == 16


def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        for t in range(5):
            x = float(rng.normal(g * 2, 1))
            rows.append((f"c{g}", t, x, 1.5 * x - 4.0 * g + 0.3 * t + float(rng.normal(0, 0.2))))
    return spark.createDataFrame(rows[:-2], "city string, t int, x double, y double")


def test_within_slope_equals_dummy_slope(spark):
    df = panel(spark)
    within = cs.fixed_effects(df, "y", ["x"], "city")
    dummies = rg.ols(df, "y", {**rg.numeric("x"), **rg.categorical(df, "city")})
    assert within["x"] == pytest.approx(dummies["x"], abs=1e-9)
    assert within.se[0] == pytest.approx(dummies.se[1], rel=1e-9)


def test_two_way_effects_both_ways(spark, monkeypatch):
    df = panel(spark)
    full = rg.ols(df, "y", {**rg.numeric("x"), **rg.categorical(df, "city"), **rg.categorical(df, "t")})
    exact = cs.fixed_effects(df, "y", ["x"], "city", "t")
    assert exact["x"] == pytest.approx(full["x"], abs=1e-8)
    assert exact.dof == full.dof
    monkeypatch.setattr(cs, "TIME_DUMMIES", 0)
    turns = cs.fixed_effects(df, "y", ["x"], "city", "t")
    assert turns["x"] == pytest.approx(full["x"], abs=1e-6)
    assert turns.dof == full.dof


def test_tail_probabilities():
    # Textbook quantiles: 5% points of each distribution.
    assert tails.t_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert tails.f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.studentized_range_sf(3.877676, 3, 10) == pytest.approx(0.05, abs=2e-3)


def test_tests_of_two_groups_agree(spark):
    """With two groups F is the square of t, and both p values agree."""
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (3, 5, 6, 7)], "g string, v double")
    t, f = st.ttest(df, "v", "g", "a", "b").first(), st.anova(df, "v", "g").first()
    assert t["t"] ** 2 == pytest.approx(f["f"]) and t["p"] == pytest.approx(f["p"])
    tukey = st.tukey(df, "v", "g").first()
    assert tukey["diff"] == pytest.approx(2.75) and tukey["p"] == pytest.approx(t["p"], abs=5e-3)


def test_chi_squared_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    r = st.chi2(spark.createDataFrame(rows, "g string, h string"), "g", "h").first()
    e = {("a", "x"): 30 * 40 / 65, ("a", "y"): 30 * 25 / 65, ("b", "x"): 35 * 40 / 65, ("b", "y"): 35 * 25 / 65}
    o = {k: rows.count(k) for k in e}
    want = sum((abs(o[k] - e[k]) - 0.5) ** 2 / e[k] for k in e)
    assert r["chi2"] == pytest.approx(want) and r["dof"] == 1


def test_audit_finds_each_breach(spark):
    rows = [("w1", "mon", "early"), ("w1", "mon", "late"), ("w2", "mon", "early"), (None, "tue", "early")]
    df = spark.createDataFrame(rows, "worker string, day string, slot string")
    out = {(r["rule"], r["where"]): (r["found"], r["wanted"]) for r in ag.audit_assignment(df, "worker", "day", "slot", {"early": 2, "late": 1}, 2).collect()}
    assert out == {("cover", "tue/early"): (0, 2), ("load", "w2"): (1, 2), ("one_slot", "w1/mon"): (2, 1)}


def test_settings_grow_with_the_input():
    from tabulon.plans.settings import settings_for

    assert settings_for(10**6, 8)["spark.sql.shuffle.partitions"] == "16"
    assert settings_for(10**13, 8)["spark.sql.shuffle.partitions"] == "37253"
    assert settings_for(10**15, 8000)["spark.sql.shuffle.partitions"] == "100000"
