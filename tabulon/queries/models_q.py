import datetime
import math

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulon.operators import models as md, regression as rg
from tabulon.operators.front import pareto_front
from tabulon.operators.gradient import fit_layers, fit_perceptron
from tabulon.operators.rows import split
from tabulon.operators.trees import tree_contributions

from tabulon.queries.regression_q import ols2
from tabulon.queries.registry import R, U, query, rnd, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
XS = ["l_quantity", "l_discount", "l_tax"]


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(*KEY, *XS, "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("k_chars"), (F.col("lang") == "en").cast("int").alias("english"))
    return table(spark, sf, "labels").join(d, "doc_id")


def _vectors(spark, sf):
    return md.vector_column(table(spark, sf, "embeddings"), "embedding")


@query("m01_linear_fit_predict")
def _(spark, sf):
    _, pred = md.fit_linear(_li(spark, sf), "l_extendedprice", XS, 0.2, 1, KEY)
    return pred.select(*KEY, "l_extendedprice", rnd("prediction", 4).alias("prediction"))


@query("m02_logistic")
def _(spark, sf):
    model, data = md.fit_logistic(_docs(spark, sf), "quality", ["k_chars", "english"])
    return model.transform(data).select("doc_id", "quality", "prediction")


@query("m03_softmax")
def _(spark, sf):
    data = _vectors(spark, sf)
    return md.fit_softmax(data, "label", iterations=20).transform(data).select("vec_id", "label", "prediction")


@query("m04_linear_separator")
def _(spark, sf):
    df = _docs(spark, sf).withColumn("side", F.when(F.col("quality") == 1, 1).otherwise(-1))
    model, data = md.fit_separator(df, "side", ["k_chars", "english"], 20)
    return model.transform(data).select("doc_id", "side", "prediction")


# Parts on either side of a line, without those next to it.
SIDES = "(select p_partkey, p_size / 50.0 + p_retailprice / 2000.0 - 1.1 as d from part)"


@query("m04_perceptron_mistakes", f"select count(*) as n, count(*) filter (d > 0) as above, cast(0 as bigint) as mistakes, true as separates from {SIDES} where abs(d) > 0.05")
def _(spark, sf):
    d = F.col("p_size") / 50.0 + F.col("p_retailprice") / 2000.0 - 1.1
    df = table(spark, sf, "part").withColumn("d", d).filter(F.abs("d") > 0.05).withColumn("side", F.signum("d").cast("int"))
    df = df.withColumns({"size": F.col("p_size") / 50, "price": F.col("p_retailprice") / 2000})
    fit = fit_perceptron(df, "side", ["size", "price"], 200)
    wrong = F.count(F.when(fit.side(["size", "price"]) != F.col("side"), 1))
    return df.agg(F.count("*").alias("n"), F.count(F.when(F.col("side") > 0, 1)).alias("above"), wrong.alias("mistakes")).withColumn("separates", F.lit(fit.separates))


@query(
    "m05_rectified_layers",
    "select count(*) as n, true as better_than_guessing, 1e0 as total_probability, true as falls from embeddings where label is not null",
)
def _(spark, sf):
    """The loss falls below that of even odds, and class probabilities add up to 1 for every row."""
    e = table(spark, sf, "embeddings")
    fit = fit_layers(e, "label", "embedding", [64, 16, 10], ["vec_id"], steps=25)
    rows = fit.predict(e.filter("label is not null"), "embedding")
    loss = F.avg(-F.log(F.get("probability", F.col("label"))))
    return rows.agg(
        F.count("*").alias("n"), (loss < math.log(10)).alias("better_than_guessing"),
        rnd(F.avg(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p))).alias("total_probability"),
    ).withColumn("falls", F.lit(fit.losses[-1] < fit.losses[0]))


@query("m05_perceptron_layers")
def _(spark, sf):
    data = _vectors(spark, sf)
    return md.fit_mlp(data, "label", [64, 32, 10], iterations=30).transform(data).select("vec_id", "label", "prediction")


@query("m06_boosted_trees")
def _(spark, sf):
    model, data = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=5, depth=3)
    return model.transform(data).select(*KEY, "l_extendedprice", "prediction")


@query("m07_grid_search")
def _(spark, sf):
    data = md.assemble(_li(spark, sf), XS)
    est = LinearRegression(labelCol="l_extendedprice", maxIter=20)
    return md.grid_search(est, data, {"regParam": [0.0, 1.0], "elasticNetParam": [0.0, 0.5]}, "l_extendedprice", KEY)


def _series(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("revenue"),
        *[F.count(F.when(F.col("o_orderpriority") == p, 1)).cast("double").alias(n) for n, p in (("tv", "1-URGENT"), ("search", "2-HIGH"))],
        F.avg("o_custkey").alias("control"),
    )
    return d


@query("m08_search_front")
def _(spark, sf):
    """Of all rates, those that no other beats in both error and distance of the shares."""
    cuts = datetime.date(1999, 1, 1), datetime.date(2000, 1, 1)
    grid = {c: [i / 10 for i in range(10)] for c in ("tv", "search")}
    return pareto_front(md.search_adstock(_series(spark, sf), "revenue", ["day"], grid, ["control"], "day", *cuts), "valid_rmse", "rssd")


@query(
    "m08_pareto_front",
    """select p_partkey, p_retailprice, p_size from part as a where not exists (select 1 from part as b
    where b.p_retailprice <= a.p_retailprice and b.p_size <= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size < a.p_size))""",
)
def _(spark, sf):
    return pareto_front(table(spark, sf, "part"), "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


@query("m08_search_adstock")
def _(spark, sf):
    grid = {"tv": [0.1, 0.3, 0.5, 0.8], "search": [0.0, 0.2, 0.4]}
    return md.search_adstock(
        _series(spark, sf), "revenue", ["day"], grid, ["control"], "day", datetime.date(1999, 1, 1), datetime.date(2000, 1, 1)
    )


@query("m08_search_model_size")
def _(spark, sf):
    return md.search_model_size(
        _series(spark, sf), "revenue", ["day"], {"tv": 0.3, "search": 0.2}, ["control"], [(5, 2), (5, 4), (15, 2)], "day",
        datetime.date(1999, 1, 1), datetime.date(2000, 1, 1),
    )


@query("m09_kmeans")
def _(spark, sf):
    return md.kmeans(_vectors(spark, sf), "features", 5)[1].select("vec_id", "label", "cluster")


@query("m10_silhouette")
def _(spark, sf):
    return md.silhouette(_vectors(spark, sf), "features", range(2, 5))


@query("m11_elbow")
def _(spark, sf):
    return md.elbow(_vectors(spark, sf), "features", range(2, 5))


@query("m12_principal_components")
def _(spark, sf):
    df = md.pca(_vectors(spark, sf), "features", 2)
    return df.select("vec_id", F.col("components")[0].alias("pc1"), F.col("components")[1].alias("pc2"))


@query("m13_importance")
def _(spark, sf):
    model, _ = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=3, depth=3)
    return md.importance(model, XS, spark)


@query("m13_permutation_importance")
def _(spark, sf):
    model, _ = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=3, depth=3)
    return md.permutation_importance(model, _li(spark, sf), "l_extendedprice", XS, KEY)


CONTRIB = ols2("lineitem", "l_extendedprice", "l_quantity", "l_discount")


@query(
    "m14_linear_contributions",
    CONTRIB + f"""select 'l_quantity' as feature, {R('avg(abs(b1 * (l_quantity - m1)))', 4)} as mean_abs from lineitem, e
    union all select 'l_discount', {R('avg(abs(b2 * (l_discount - m2)))', 4)} from lineitem, e""",
)
def _(spark, sf):
    xs = ["l_quantity", "l_discount"]
    fit = rg.ols(_li(spark, sf), "l_extendedprice", xs)
    return md.mean_contribution(md.contributions(fit, _li(spark, sf), xs), xs).withColumn("mean_abs", rnd("mean_abs", 4))


@query("m14_tree_contributions", f"select count(*) as n, 0e0 as gap, 0e0 as left_over, {R('avg(l_extendedprice)', 2)} as base from lineitem")
def _(spark, sf):
    """Effects add up to the prediction less the base; over the training rows they balance, and the base is the mean."""
    model, data = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=5, depth=3)
    df = tree_contributions(model, model.transform(data), XS, data)
    total = sum(F.col(f"{x}_effect") for x in XS)
    return df.agg(
        F.count("*").alias("n"), rnd(F.max(F.abs(total - (F.col("prediction") - F.col("base")))), 4).alias("gap"),
        rnd(F.avg(total), 4).alias("left_over"), rnd(F.first("base"), 2).alias("base"),
    )


@query("m14_mean_tree_contribution")
def _(spark, sf):
    model, data = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=5, depth=3)
    return md.mean_contribution(tree_contributions(model, data, XS, data), XS)


@query(
    "m15_effect_and_spend_shares",
    CONTRIB + f""", s as (select sum(abs(b1 * (l_quantity - m1))) as e1, sum(abs(b2 * (l_discount - m2))) as e2, sum(l_quantity) as s1, sum(l_discount) as s2 from lineitem, e),
    g as (select e1 / (e1 + e2) as a1, e2 / (e1 + e2) as a2, s1 / (s1 + s2) as c1, s2 / (s1 + s2) as c2 from s)
    select 'l_quantity' as channel, {R('a1')} as effect_share, {R('c1')} as spend_share, {R('sqrt(power(a1 - c1, 2) + power(a2 - c2, 2))')} as rssd from g
    union all select 'l_discount', {R('a2')}, {R('c2')}, {R('sqrt(power(a1 - c1, 2) + power(a2 - c2, 2))')} from g""".replace(", s as", ", sh as").replace("from s)", "from sh)"),
)
def _(spark, sf):
    xs = ["l_quantity", "l_discount"]
    fit = rg.ols(_li(spark, sf), "l_extendedprice", xs)
    df = md.effect_vs_spend(md.contributions(fit, _li(spark, sf), xs), xs)
    return df.select("channel", *[rnd(c).alias(c) for c in ("effect_share", "spend_share", "rssd")])


def _rated(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 1000).alias("price"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(orders, "l_orderkey").join(part, "l_partkey")


RIDGE = f"""with r as (select o_custkey, l_quantity as y, p_size / 50 as x1, p_retailprice / 1000 as x2 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
s as (select o_custkey, avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(x1) * count(*) + 0.01 as a, covar_pop(x1, x2) * count(*) as b, var_pop(x2) * count(*) + 0.01 as c,
 covar_pop(x1, y) * count(*) as p, covar_pop(x2, y) * count(*) as q from r group by 1),
w as (select *, (c * p - b * q) / (a * c - b * b) as w0, (a * q - b * p) / (a * c - b * b) as w1 from s)
select o_custkey, {R('my - w0 * m1 - w1 * m2')} as intercept, {R('w0')} as w0, {R('w1')} as w1 from w"""


@query("m16_ridge_per_user", RIDGE)
def _(spark, sf):
    out = md.ridge_per_group(_rated(spark, sf), "o_custkey", "l_quantity", ["size", "price"], 0.01)
    return out.select("o_custkey", rnd("intercept").alias("intercept"), *[rnd(F.col("weights")[i]).alias(f"w{i}") for i in range(2)])


@query("m18_model_bands")
def _(spark, sf):
    parts = split(_li(spark, sf), {"train": 0.7, "test": 0.3}, 1, KEY)
    out = md.model_bands(parts.filter("part = 'train'"), parts.filter("part = 'test'"), "l_extendedprice", XS, 5, trees=3, depth=3)
    return out.select(*KEY, "prediction", "band")


RESULTS = """with t as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem where l_shipdate < timestamp '1999-01-01'),
r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice as y, cast(trunc(a + b * l_quantity) as bigint) as p,
case when l_shipdate < timestamp '1999-01-01' then 'train' when l_shipdate < timestamp '2000-06-01' then 'valid' else 'test' end as data_type from lineitem, t) """


def _results(spark, sf):
    cuts = datetime.datetime(1999, 1, 1), datetime.datetime(2000, 6, 1)
    return md.result_table(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_shipdate", *cuts)


@query("m19_result_table", RESULTS + f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, data_type, p as predicted, {R('p / y - 1')} as percentage from r")
def _(spark, sf):
    return _results(spark, sf).select(*KEY, "data_type", "predicted", rnd("percentage").alias("percentage"))


@query(
    "m19_daily_error",
    RESULTS + f", d as (select data_type, l_shipdate, sum(p) as p, sum(y) as y from r group by 1, 2) select data_type, {R('avg(abs(p - y))')} as mae from d group by 1",
)
def _(spark, sf):
    return md.daily_error(_results(spark, sf), "l_shipdate").withColumn("mae", rnd("mae"))


@query(
    "x07_model_per_group",
    f"select l_returnflag, {R('regr_intercept(l_extendedprice, l_quantity)', 2)} as intercept, {R('regr_slope(l_extendedprice, l_quantity)', 3)} as slope from lineitem group by 1",
)
def _(spark, sf):
    out = md.fit_per_group(_li(spark, sf), "l_returnflag", "l_extendedprice", ["l_quantity"])
    return out.select("l_returnflag", rnd("intercept", 2).alias("intercept"), rnd(F.col("weights")[0], 3).alias("slope"))


# A fit is right where its equations hold; what is left of them, beside their own size, must round to zero.


def _left(df, residual, xs, y, digits):
    """Sum of residual times column over the sum of their sizes, per column."""
    size = lambda x: F.sum(F.abs(F.col(x)) * F.greatest(F.abs(F.col(y)), F.lit(1.0)))
    return df.agg(*[rnd(F.sum(residual * F.col(x)) / size(x), digits).alias(x) for x in xs])


@query("m01_normal_equations", "select 0e0 as one, 0e0 as l_quantity, 0e0 as l_discount, 0e0 as l_tax")
def _(spark, sf):
    model, _ = md.fit_linear(_li(spark, sf), "l_extendedprice", XS, 0.2, 1, KEY)
    train = md.assemble(split(_li(spark, sf), {"train": 0.8, "test": 0.2}, 1, KEY).filter("part = 'train'"), XS)
    fitted = model.transform(train).withColumn("one", F.lit(1.0))
    return _left(fitted, F.col("l_extendedprice") - F.col("prediction"), ["one", *XS], "l_extendedprice", 7)


@query("m02_score_equations", "select 0e0 as one, 0e0 as k_chars, 0e0 as english")
def _(spark, sf):
    model, data = md.fit_logistic(_docs(spark, sf), "quality", ["k_chars", "english"])
    fitted = model.transform(data).withColumn("one", F.lit(1.0))
    return _left(fitted, F.col("quality") - vector_to_array("probability")[1], ["one", "k_chars", "english"], "one", 4)


@query("m09_nearest_centres", "select 5 as clusters, 0 as elsewhere, count(*) as n from embeddings")
def _(spark, sf):
    model, rows = md.kmeans(_vectors(spark, sf), "features", 5)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    x = vector_to_array("features")
    far = F.transform(centres, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    own = F.get(far, F.col("cluster"))
    rows = rows.withColumn("elsewhere", (own > F.array_min(far) + 1e-6).cast("int"))
    return rows.agg(F.count_distinct("cluster").cast("int").alias("clusters"), F.sum("elsewhere").cast("int").alias("elsewhere"), F.count("*").alias("n"))


@query("m12_component_moments", "select 0e0 as mean1, 0e0 as mean2, 0e0 as correlation, true as in_order, count(*) as n from embeddings")
def _(spark, sf):
    df = md.pca(_vectors(spark, sf), "features", 2).select(F.col("components")[0].alias("a"), F.col("components")[1].alias("b"))
    return df.agg(
        rnd(F.avg("a")).alias("mean1"), rnd(F.avg("b")).alias("mean2"), rnd(F.corr("a", "b")).alias("correlation"),
        (F.var_pop("a") >= F.var_pop("b")).alias("in_order"), F.count("*").alias("n"),
    )


@query(
    "m13_importance_total",
    """with y as (select *, l_quantity + 100 * l_discount as y from lineitem)
    select 3 as features, 1e0 as total, max_by(feature, size) as first, min_by(feature, size) as last from (
      select unnest(['l_quantity', 'l_discount', 'l_tax']) as feature, unnest([abs(corr(l_quantity, y)), abs(corr(l_discount, y)), abs(corr(l_tax, y))]) as size from y)""",
)
def _(spark, sf):
    """Shares add up to 1, and they order the features as their correlations with the response do."""
    li = _li(spark, sf).withColumn("y", F.col("l_quantity") + 100 * F.col("l_discount"))
    model, _ = md.fit_gbt(li, "y", XS, trees=3, depth=3)
    return md.importance(model, XS, spark).agg(
        F.count("*").cast("int").alias("features"), rnd(F.sum("importance")).alias("total"),
        F.max_by("feature", "importance").alias("first"), F.min_by("feature", "importance").alias("last"),
    )


@query(
    "m03_softmax_score",
    f"""select 2 * quality + toxic as class, count(*) as n, {R('count(*) / sum(count(*)) over ()', 3)} as share from labels join documents using (doc_id) group by 1""",
)
def _(spark, sf):
    """At the fit the mean probability of each class is its share of the rows."""
    df = table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "k_chars", "english"), "doc_id").withColumn("class", (2 * F.col("quality") + F.col("toxic")).cast("int"))
    rows = md.fit_softmax(md.assemble(df, ["k_chars", "english"]), "class", iterations=300).transform(df.transform(lambda d: md.assemble(d, ["k_chars", "english"])))
    p = vector_to_array("probability")
    means = rows.agg(*[F.avg(F.get(p, F.lit(k))).alias(str(k)) for k in range(4)]).unpivot([], [str(k) for k in range(4)], "class", "share")
    counts = rows.groupBy("class").agg(F.count("*").alias("n"))
    return counts.join(means.withColumn("class", F.col("class").cast("int")), "class").select("class", "n", rnd("share", 3).alias("share"))


@query("m06_leaf_means", f"select count(*) as n, 0e0 as gap, {R('avg(l_extendedprice)', 2)} as mean, true as at_most_eight from lineitem")
def _(spark, sf):
    """Every leaf of a first tree predicts the mean of its rows."""
    model, data = md.fit_gbt(_li(spark, sf), "l_extendedprice", XS, trees=1, depth=3)
    leaves = model.transform(data).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"))
    return leaves.agg(
        F.sum("n").alias("n"), rnd(F.max(F.abs(F.col("mean") - F.col("prediction"))), 4).alias("gap"),
        rnd(F.sum(F.col("prediction") * F.col("n")) / F.sum("n"), 2).alias("mean"), (F.count("*") <= 8).alias("at_most_eight"),
    )


@query(
    "m07_cross_validated_error",
    f"""with u as (select *, cast(least(floor({U(*KEY, seed=1)} * 3), 2) as int) as fold from lineitem),
    fits as (select f.fold, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a
      from (select distinct fold from u) as f join u on u.fold <> f.fold group by f.fold),
    errors as (select fold, sqrt(avg(power(l_extendedprice - a - b * l_quantity, 2))) as e from u join fits using (fold) group by fold)
    select 0e0 as "regParam", {R('avg(e)', 2)} as rmse from errors""",
)
def _(spark, sf):
    data = md.assemble(_li(spark, sf), ["l_quantity"])
    est = LinearRegression(labelCol="l_extendedprice", solver="normal")
    return md.grid_search(est, data, {"regParam": [0.0]}, "l_extendedprice", KEY).withColumn("rmse", rnd("rmse", 2))


@query(
    "m18_band_rows",
    f"select count(*) as n, true as in_bands, true as rises from lineitem where {U(*KEY, seed=1)} >= 0.7",
)
def _(spark, sf):
    """Every test row has a band from 1 to 5, and predictions rise with the band."""
    parts = split(_li(spark, sf), {"train": 0.7, "test": 0.3}, 1, KEY)
    out = md.model_bands(parts.filter("part = 'train'"), parts.filter("part = 'test'"), "l_extendedprice", XS, 5, trees=3, depth=3)
    per = out.groupBy("band").agg(F.count("*").alias("n"), F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    rises = F.forall(F.array_sort(F.collect_list(F.struct("low", "high", "band"))), lambda x: (x["low"] <= x["high"]) & x["band"].between(1, 5))
    later = F.array_sort(F.collect_list(F.struct("band", "low")))
    return per.agg(F.sum("n").alias("n"), rises.alias("in_bands"), (F.transform(later, lambda x: x["low"]) == F.array_sort(F.collect_list("low"))).alias("rises"))
