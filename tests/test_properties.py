"""Properties, brute-force comparisons and edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars as sc
from tabulon.operators import aggregates as ag, bandit as bd, causal as cs, charts as ch, graph as gr, models as md
from tabulon.operators import ranking as rk, recommend as rc, regression as rg, relational as rel, rows as rw, stats as st, windows as wn
from tabulon.plans.quantiles import quantile_table


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(100, 3, 300), rng.normal(-2, 1, 300)
    y = 4 + 2 * x - 3 * z + rng.normal(0, 1, 300)
    rows = [(i, float(a), float(b), float(c), "abc"[i % 3]) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(rows, "id int, x double, z double, y double, g string").cache()


def test_least_squares_against_numpy(numbers):
    p = numbers.toPandas()
    a = np.column_stack([np.ones(len(p)), p["x"], p["z"]])
    beta, sse, *_ = np.linalg.lstsq(a, p["y"], rcond=None)
    fit = rg.ols(numbers, "y", ["x", "z"])
    assert fit.coef == pytest.approx(beta, rel=1e-9)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * sse[0] / (len(p) - 3))
    assert fit.se == pytest.approx(se, rel=1e-7)
    raw = rg.ols(numbers, "y", ["x", "z"], intercept=False)
    assert raw.coef == pytest.approx(np.linalg.lstsq(a[:, 1:], p["y"], rcond=None)[0], rel=1e-8)


def test_partialling_out_equals_long_model(numbers):
    assert rg.partial_out(numbers, "y", "x", ["z"]).first()["slope"] == pytest.approx(rg.ols(numbers, "y", ["x", "z"])["x"], rel=1e-9)


def test_diagnostics(numbers):
    p = rg.diagnostics(numbers, "y", ["x", "z"]).toPandas()
    assert p["leverage"].sum() == pytest.approx(3) and abs(p["residual"].sum()) < 1e-6


def test_clustered_error_with_one_row_per_cluster_is_robust(numbers):
    """With every row its own pair and many entities the meat is the sum of squared scores."""
    df = numbers.withColumn("e", F.col("id") % 50)
    out = cs.clustered(df, "y", ["x", "z"], "e").collect()
    fit = cs.fixed_effects(df, "y", ["x", "z"], "e")
    assert [r["coef"] for r in out] == pytest.approx([fit["x"], fit["z"]])
    assert all(0.3 < r["se"] / s < 3 for r, s in zip(out, fit.se))


def test_double_residual_effect_finds_slope(numbers):
    # The simulated slope is 2, but the sample's own slope is what both estimators see.
    out = cs.treatment_effects(numbers, "y", ["x"], ["z"], 4, 7, ["id"]).first()
    fit = rg.ols(numbers, "y", ["x", "z"])
    assert abs(out["effect"] - fit["x"]) < 0.1 * fit.se[1]
    assert out["se"] == pytest.approx(fit.se[1], rel=0.25) and out["p"] < 1e-6
    seg = cs.effect_by_segment(numbers, "y", "x", ["z"], ["g"], 4, 7, ["id"]).collect()
    assert len(seg) == 3 and all(abs(r["effect"] - 2) < 0.3 for r in seg)


def test_pretest_keeps_long_model_when_control_matters(numbers):
    r = cs.pretest(numbers.withColumn("one", F.lit(1)), "y", "x", "z", ["one"]).first()
    assert r["p"] < 0.05 and r["pretest"] == r["long"] and r["long"] == pytest.approx(rg.ols(numbers, "y", ["x", "z"])["x"], rel=1e-8)


def test_logit_matches_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    a, b = np.column_stack([x, np.ones(400)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ b))
        h = a.T @ (a * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, a.T @ (y - p))
    got = {r["term"]: r for r in rg.logit(df, "y", ["x"]).collect()}
    assert got["x"]["coef"] == pytest.approx(b[0], abs=1e-5) and got["Intercept"]["coef"] == pytest.approx(b[1], abs=1e-5)
    assert got["x"]["se"] == pytest.approx(np.sqrt(np.linalg.inv(h)[0, 0]), rel=1e-4)


def test_divergences(spark):
    df = spark.createDataFrame([(0.2, 0.5), (0.3, 0.25), (0.5, 0.25)], "p double, q double")
    assert st.kl(df, "p", "p").first()[0] == 0
    ab, ba = st.jsd(df, "p", "q").first()[0], st.jsd(df, "q", "p").first()[0]
    assert ab == pytest.approx(ba) and 0 < ab < math.log(2)
    scaled = df.withColumn("p", F.col("p") * 7)
    assert st.jsd(scaled, "p", "q").first()[0] == pytest.approx(ab)


def test_split_covers_and_is_stable(numbers):
    parts = rw.split(numbers, {"a": 0.6, "b": 0.3, "c": 0.1}, 9, ["id"])
    first = {r["id"]: r["part"] for r in parts.collect()}
    again = {r["id"]: r["part"] for r in rw.split(numbers.repartition(7), {"a": 0.6, "b": 0.3, "c": 0.1}, 9, ["id"]).collect()}
    assert len(first) == 300 and first == again
    share = Counter(first.values())
    assert abs(share["a"] / 300 - 0.6) < 0.12 and set(share) == {"a", "b", "c"}


def test_samples(numbers):
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(rw.sample_n(numbers, 40, 3, ["id"])) == ids(rw.sample_n(numbers.repartition(5), 40, 3, ["id"]))
    drawn = rw.sample_with_replacement(numbers, 500, 3, ["id"])
    assert drawn.count() == 500 and len(set(ids(drawn))) < 300


def test_quantiles_against_numpy(numbers):
    p = numbers.toPandas()
    for limit in (None, 0):
        rows = quantile_table(numbers, ["x"], [0.1, 0.25, 0.77], distinct_values=limit).collect()
        for r in rows:
            assert r["value"] == pytest.approx(np.quantile(p["x"], r["prob"]), rel=1e-12)


@pytest.mark.parametrize("how", [{}, {"shard_items": 7}, {"centres": 1, "shard_items": 5, "user_block": 4}, {"centres": 40, "shard_items": 2}])
def test_topk_products_against_brute_force(spark, how):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(23, 4)).round(2), rng.normal(size=(31, 4)).round(2)
    # Equal items tie, a zero vector scores 0 everywhere, and half of the items are one vector.
    v = np.vstack([v, v[3], v[3] * 0, *[v[7]] * 30])
    users = spark.createDataFrame([(f"u{i}", [float(x) for x in r]) for i, r in enumerate(u)] + [("none", None)], "u string, vec array<double>")
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(-1, None)], "i long, vec array<double>").repartition(3)
    n = len(v)
    seen = {(int(a), int(b)) for a, b in zip(rng.integers(0, 23, 400), rng.integers(0, n, 400))} | {(5, j) for j in range(n - 2)}
    pairs = spark.createDataFrame([(f"u{a}", b) for a, b in sorted(seen)] + [("u1", 99), (None, 1), ("gone", 2), ("u2", None)], "u string, i long")
    rows = rk.topk_products(users, items, 4, "u", "i", "vec", pairs, **how).collect()
    got = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in rows}
    assert len(rows) == len(got)
    for a in range(23):
        left = sorted([(-np.einsum("i,i", u[a], v[b]).round(9), b) for b in range(n) if (a, b) not in seen])[:4]
        for rank, (s, b) in enumerate(left, 1):
            assert got[f"u{a}", rank] == (b, pytest.approx(-s))
        assert (f"u{a}", len(left) + 1) not in got
    assert not [key for key in got if key[0] == "none"]
    assert rk.topk_products(users, items.limit(0), 4, "u", "i", "vec", pairs).count() == 0 and rk.topk_products(users.limit(0), items, 4, "u", "i", "vec").count() == 0


def test_blocks_that_cannot_win_are_skipped():
    from tabulon.operators import best_k as bk

    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, 3000)] * 5 + rng.normal(size=(3000, 12)) * 0.3
    centres = bk.fit_centres(x[:500], 24)
    own = bk.nearest_centre(x, centres)
    at = [np.flatnonzero(own == b) for b in range(24)]
    radius = np.array([np.sqrt(((x[i] - c) ** 2).sum(axis=1)).max(initial=0) for i, c in zip(at, centres)])
    length = np.array([np.sqrt((x[i] ** 2).sum(axis=1)).max(initial=0) for i in at])
    ones = np.array([int(len(i) > 0) for i in at])
    blocks = bk.Blocks(centres, radius, length, np.arange(24), ones, 24)
    shard = bk.Shard(blocks, list(range(3000)), own, x)
    for _ in range(30):
        u, hidden = rng.normal(size=12), rng.integers(0, 3000, 200).tolist()
        found, visited = shard.best(u, 5, None, hidden)
        want = sorted((-s, i) for i, s in enumerate(x @ u) if i not in hidden)[:5]
        assert [i for i, _ in found] == [i for _, i in want] and visited < ones.sum() / 2
        # With the k-th score known, only blocks that reach it are visited, and shards that hold none are not asked.
        again, fewer = shard.best(u, 5, found[-1][1], hidden)
        assert again == found and fewer <= visited
        home, others = blocks.wanted(u, found[-1][1])
        assert {int(own[i]) for i, _ in found} <= {home, *others} and len(others) < ones.sum() / 2


def test_nearest_leaves_out_itself(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0])], "id long, vec array<double>")
    best = {r["query"]: r["id"] for r in rk.nearest(df, df, 1, "id", "id", "vec").collect()}
    assert best[0] == 1 and best[1] == 0 and best[2] == 1


def test_ranking_quality(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "u int, i int")
    ideal = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "u int, i int, rank int")
    assert rk.ndcg(ideal, truth, 5, "u", "i").first()[0] == pytest.approx(1.0)
    none = ideal.withColumn("i", F.col("i") + 100)
    assert rk.ndcg(none, truth, 5, "u", "i").first()[0] == 0
    r = rk.precision_recall(ideal, truth, 2, "u", "i").first()
    assert r["precision"] == pytest.approx(0.75) and r["recall"] == pytest.approx(1.0)


@pytest.mark.parametrize("group_rows", [None, 0])
def test_negative_samples_are_unseen_and_complete(spark, group_rows, small_blocks):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 6, 60), rng.integers(0, 20, 60))}
    pairs |= {(99, i) for i in range(20)} | {(98, i) for i in range(19)}
    edges = spark.createDataFrame(sorted(pairs), "user long, item long")
    items = spark.createDataFrame([(i,) for i in range(20)], "item long")
    out = rc.sample_negatives(edges, items, 4, group_rows=group_rows).collect()
    assert {(r["user"], r["item"]) for r in out} == {p for p in pairs if p[0] != 99}
    assert all((r["user"], r["negative"]) not in pairs and 0 <= r["negative"] < 20 for r in out)
    assert {r["negative"] for r in out if r["user"] == 98} == {19}


@pytest.mark.parametrize("group_rows", [None, 0])
def test_weighted_samples_follow_root_counts(spark, group_rows, small_blocks):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 25 + [("c",)], "item string")
    out = Counter(r["item"] for r in rc.sample_weighted(df, "item", 3200, 5, group_rows=group_rows).collect())
    assert sum(out.values()) == 3200
    for item, w in (("a", 10 / 16), ("b", 5 / 16), ("c", 1 / 16)):
        assert abs(out[item] / 3200 - w) < 0.04


def test_user_similarity_against_pandas(spark):
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)): float(rng.integers(1, 6)) for a, b in zip(rng.integers(0, 9, 90), rng.integers(0, 12, 90))}
    df = spark.createDataFrame([(a, b, r) for (a, b), r in sorted(pairs.items())], "user long, item long, rating double")
    wide = df.toPandas().pivot(index="user", columns="item", values="rating")
    want = wide.T.corr(min_periods=1)[3]
    got = {r["user"]: r["sim"] for r in rc.user_corr(df, df.filter("user = 3")).collect()}
    assert 3 not in got
    for u, s in got.items():
        assert (s is None and math.isnan(want[u])) or s == pytest.approx(want[u], abs=1e-9)
    norm = wide.sub(wide.mean(axis=1), axis=0).fillna(0).to_numpy()
    got = {r["user"]: r["sim"] for r in rc.user_cosine(df, df.filter("user = 3")).collect()}
    for u, s in got.items():
        i, j = list(wide.index).index(u), list(wide.index).index(3)
        assert s == pytest.approx(norm[i] @ norm[j] / np.linalg.norm(norm[i]) / np.linalg.norm(norm[j]), abs=1e-9)


def test_ridge_per_group_against_closed_form(numbers):
    p = numbers.toPandas()
    for r in md.ridge_per_group(numbers, "g", "y", ["x", "z"], 0.01).collect():
        q = p[p["g"] == r["g"]]
        x, y = q[["x", "z"]].to_numpy(), q["y"].to_numpy()
        xc = x - x.mean(axis=0)
        w = np.linalg.solve(xc.T @ xc + 0.01 * np.eye(2), xc.T @ (y - y.mean()))
        assert r["weights"] == pytest.approx(w, rel=1e-6) and r["intercept"] == pytest.approx(y.mean() - x.mean(axis=0) @ w, rel=1e-5)


def test_adstock_search_finds_the_rate(spark):
    rng = np.random.default_rng(9)
    x, c, y, carry = rng.gamma(2, 2, 400), rng.normal(size=400), [], 0.0
    for a, b in zip(x, c):
        carry = a + 0.6 * carry
        y.append(5 + 2 * carry + b + rng.normal(0, 0.1))
    rows = [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(x, c, y))]
    df = spark.createDataFrame(rows, "t int, x double, c double, y double")
    out = md.search_adstock(df, "y", ["t"], {"x": [0.2, 0.6, 0.9]}, ["c"], "t", 300, 300).collect()
    assert out[0]["x_rate"] == 0.6
    # The block arithmetic gives the error of an ordinary fit.
    one = wn.adstock(df, {"x": 0.6}, ["t"])
    fit = rg.ols(one.filter("t < 300"), "y", ["x_adstock", "c"])
    test = one.filter("t >= 300").withColumn("p", fit.predict(["x_adstock", "c"]))
    assert out[0]["test_rmse"] == pytest.approx(rg.regression_metrics(test, "y", "p").first()["rmse"], rel=1e-6)


def test_propagation_against_matrix(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2)]
    sym = gr.symmetrize(spark.createDataFrame(pairs, "user long, item long"))
    adj = np.zeros((6, 6))
    for u, i in pairs:
        adj[u, i + 3] = adj[i + 3, u] = 1
    d = adj.sum(axis=1)
    norm = adj / np.sqrt(np.outer(d, d))
    e = np.arange(12, dtype=float).reshape(6, 2)
    want = (e + norm @ e + norm @ norm @ e) / 3
    emb = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(e)], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in gr.propagate(gr.gcn_norm(sym), emb, 2, 2).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(want[i])
    back = {(r["user"], r["item"]) for r in gr.bipartite(sym, 3).collect()}
    assert back == set(pairs)


def test_density_sums_to_one(numbers):
    p = ch.kde(numbers, "x", 200, bandwidth=0.5).toPandas().sort_values("x")
    assert np.trapezoid(p["density"], p["x"]) == pytest.approx(1.0, abs=0.02)


def test_smooth_follows_a_line(spark):
    df = spark.range(500).select((F.col("id") / 10).alias("x"), (3 + F.col("id") / 5).alias("y"))
    for r in ch.smooth(df, "x", "y", 20, 0.4).collect():
        assert r["trend"] == pytest.approx(3 + 2 * r["x"], abs=1e-6)


def test_partial_autocorrelation_first_lag(numbers):
    a = {r["lag"]: r["acf"] for r in wn.acf(numbers, "y", 3, ["id"]).collect()}
    p = {r["lag"]: r["pacf"] for r in wn.pacf(numbers, "y", 3, ["id"]).collect()}
    assert p[0] == 1 and p[1] == pytest.approx(a[1]) and p[2] == pytest.approx((a[2] - a[1] ** 2) / (1 - a[1] ** 2))


def test_thompson_prefers_the_better_arm(spark):
    stats = spark.createDataFrame([(0, 1000, 100), (1, 1000, 150)], "arm long, shown long, clicks long")
    share = {r["arm"]: r["win_share"] for r in bd.thompson_draws(bd.thompson(stats, "arm"), "arm", 400, 1).collect()}
    assert share[1] > 0.95 and sum(share.values()) == pytest.approx(1.0)


def test_epsilon_share(spark):
    df = spark.range(4000).withColumn("c", bd.epsilon_choice(spark.range(1), F.lit(1), [0, 1, 2], 0.2, 3, ["id"]))
    got = Counter(r["c"] for r in df.collect())
    assert abs(got[1] / 4000 - 0.8) < 0.03 and got[0] > 200 and got[2] > 200


# Edge cases


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, k string, v double")
    assert wn.with_row_id(df, ["id"]).count() == 0
    assert wn.expanding(df, "v", ["id"], ["k"]).count() == 0
    assert ag.share(df, ["k"], "v").count() == 0
    assert quantile_table(df, ["v"], [0.5]).first()["value"] is None
    assert rc.sample_weighted(df, "k", 0, 1).count() == 0
    with pytest.raises(ValueError):
        rg.ols(df, "v", ["id"])


def test_single_row_and_constant(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0)], "id int, k string, v double")
    one = df.filter("id = 1")
    assert st.corr(df, ["v", "id"]).filter("a <> b").first()["corr"] is None
    assert ag.skew(one, "v").first()["skew"] is None
    assert wn.acf(df, "v", 1, ["id"]).filter("lag = 1").first()["acf"] is None
    assert ag.mode(df, "v").collect()[0]["v"] == 2.0
    assert ch.histogram(df, "v", 4).first()["n"] == 2


def test_gaps_and_zero_divisors(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, None, 4.0)], "id int, v double, w double")
    assert rel.drop_empty(df).columns == ["id", "w"]
    out = df.select(sc.pct_error("w", F.lit(0)).alias("e"), rel.clip("v", 0, 1).alias("c"), rel.row_sum(["v", "w"]).alias("s")).collect()
    assert [tuple(r) for r in out] == [(None, None, 0.0), (None, None, 4.0)]
    assert ag.ratio(df, F.sum("w"), F.sum("v")).first()[0] is None
    assert rel.replace(df, "v", {None: 1.0}).select("v").distinct().collect()[0][0] == 1.0


def test_ties_at_the_top(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 4.0)], "id int, k string, v double")
    assert [r["id"] for r in wn.topk(df, ["k"], "v", 1, ["id"]).collect()] == [1]
    assert {r["avg_rank"] for r in wn.avg_rank(df, ["k"], "v").collect()} == {1.5, 3.0}


def test_interval_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.5,)], "v double")
    got = [tuple(r) for r in df.select(sc.cut("v", [0, 1, 2], ["lo", "hi"]), sc.digitize("v", [0, 1, 2])).collect()]
    assert got == [(None, 1), ("lo", 2), ("hi", 2), ("hi", 2), (None, 2)]


def test_first_match_only(spark):
    df = spark.createDataFrame([("a1b22c",), ("none",)], "t string")
    assert [r[0] for r in df.select(sc.re_replace_first("t", r"\d+", "_")).collect()] == ["a_b22c", "none"]
