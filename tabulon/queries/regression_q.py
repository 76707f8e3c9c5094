from pyspark.sql import functions as F

from tabulon.operators import regression as rg
from tabulon.queries.registry import R, query, rnd, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEY)


def ols2(source: str, y: str, x1: str, x2: str) -> str:
    """Normal equations of two regressors, as SQL."""
    return f"""with s as (select cast(count(*) as double) as n, avg({x1}) as m1, avg({x2}) as m2, avg({y}) as my,
 var_pop({x1}) * count(*) as s11, var_pop({x2}) * count(*) as s22, covar_pop({x1}, {x2}) * count(*) as s12,
 covar_pop({x1}, {y}) * count(*) as s1y, covar_pop({x2}, {y}) * count(*) as s2y, var_pop({y}) * count(*) as syy from {source}),
b as (select *, s11 * s22 - s12 * s12 as det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from s),
e as (select *, my - b1 * m1 - b2 * m2 as b0, syy - b1 * s1y - b2 * s2y as sse, (syy - b1 * s1y - b2 * s2y) / (n - 3) as v from b) """


def coef_rows(n1: str, n2: str, d: int = 4) -> str:
    se = {
        "Intercept": ("b0", "sqrt(v * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det))"),
        n1: ("b1", "sqrt(v * s22 / det)"), n2: ("b2", "sqrt(v * s11 / det)"),
    }
    return " union all ".join(
        f"select '{t}' as term, {R(b, d)} as coef, {R(s, d)} as se, {R(f'{b} / ({s})', d)} as t from e" for t, (b, s) in se.items()
    )


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def _coef(df, d=4):
    return df.select("term", rnd("coef", d).alias("coef"), rnd("se", d).alias("se"), rnd("t", d).alias("t"))


@query(
    "t09_simple_regression",
    f"""select l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 4)} as slope, {R('regr_intercept(l_extendedprice, l_quantity)', 4)} as intercept,
    {R('regr_r2(l_extendedprice, l_quantity)')} as r2 from lineitem group by 1""",
)
def _(spark, sf):
    df = rg.ols1(_li(spark, sf), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return df.select("l_returnflag", rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"), rnd("r2").alias("r2"))


@query("t10_multiple_regression", ols2("lineitem", "l_extendedprice", "l_quantity", "l_discount") + coef_rows("l_quantity", "l_discount"))
def _(spark, sf):
    return _coef(rg.ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"]).table(spark))


@query("t10_multiple_regression_full")
def _(spark, sf):
    return rg.ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).table(spark)


@query(
    "t10_regression_summary",
    ols2("lineitem", "l_extendedprice", "l_quantity", "l_discount")
    + f"select cast(n as bigint) as n, {R('1 - sse / syy')} as r2, {R('1 - (sse / syy) * (n - 1) / (n - 3)')} as adj_r2, {R('((syy - sse) / 2) / v', 4)} as f from e",
)
def _(spark, sf):
    s = rg.ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"]).summary(spark)
    return s.select("n", rnd("r2").alias("r2"), rnd("adj_r2").alias("adj_r2"), rnd("f", 4).alias("f"))


@query(
    "t11_regression_without_intercept",
    f"""with s as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_tax) as b, sum(l_tax * l_tax) as c,
    sum(l_quantity * l_extendedprice) as p, sum(l_tax * l_extendedprice) as q from lineitem)
    select 'l_quantity' as term, {R('(c * p - b * q) / (a * c - b * b)', 4)} as coef from s
    union all select 'l_tax', {R('(a * q - b * p) / (a * c - b * b)', 4)} from s""",
)
def _(spark, sf):
    fit = rg.ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_tax"], intercept=False)
    return fit.table(spark).select("term", rnd("coef", 4).alias("coef"))


@query(
    "t12_polynomial_regression",
    ols2("lineitem", "l_extendedprice", "l_quantity", "l_quantity * l_quantity") + coef_rows("l_quantity", "l_quantity^2"),
)
def _(spark, sf):
    return _coef(rg.ols(_li(spark, sf), "l_extendedprice", rg.powers("l_quantity", 2)).table(spark))


@query(
    "t13_categorical_regression",
    f"""with m as (select avg(l_extendedprice) filter (l_returnflag = 'A') as a, avg(l_extendedprice) filter (l_returnflag = 'N') as n,
    avg(l_extendedprice) filter (l_returnflag = 'R') as r from lineitem)
    select 'Intercept' as term, {R('a', 4)} as coef from m union all select 'l_returnflag[N]', {R('n - a', 4)} from m
    union all select 'l_returnflag[R]', {R('r - a', 4)} from m""",
)
def _(spark, sf):
    li = _li(spark, sf)
    fit = rg.ols(li, "l_extendedprice", rg.categorical(li, "l_returnflag"))
    return fit.table(spark).select("term", rnd("coef", 4).alias("coef"))


@query(
    "t14_interaction_regression",
    f"""with m as (select regr_slope(l_extendedprice, l_quantity) filter (l_linestatus = 'F') as sf, regr_slope(l_extendedprice, l_quantity) filter (l_linestatus = 'O') as so,
    regr_intercept(l_extendedprice, l_quantity) filter (l_linestatus = 'F') as cf, regr_intercept(l_extendedprice, l_quantity) filter (l_linestatus = 'O') as co from lineitem)
    select 'Intercept' as term, {R('cf', 3)} as coef from m union all select 'l_quantity', {R('sf', 3)} from m
    union all select 'l_linestatus[O]', {R('co - cf', 3)} from m union all select 'l_quantity:l_linestatus[O]', {R('so - sf', 3)} from m""",
)
def _(spark, sf):
    li = _li(spark, sf)
    x, c = rg.numeric("l_quantity"), rg.categorical(li, "l_linestatus")
    fit = rg.ols(li, "l_extendedprice", {**x, **c, **rg.interact(x, c)})
    return fit.table(spark).select("term", rnd("coef", 3).alias("coef"))


@query("t14_interaction_two_numbers")
def _(spark, sf):
    x, z = rg.numeric("l_quantity"), rg.numeric("l_discount")
    return rg.ols(_li(spark, sf), "l_extendedprice", {**x, **z, **rg.interact(x, z)}).table(spark)


@query(
    "t15_regression_diagnostics",
    f"""with s as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, count(*) as n, avg(l_quantity) as m,
    regr_sxx(l_extendedprice, l_quantity) as sxx, (regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) as v from lineitem),
    d as (select {KEY_SQL}, a + b * l_quantity as fitted, l_extendedprice - a - b * l_quantity as residual, 1.0 / n + power(l_quantity - m, 2) / sxx as leverage, v from lineitem, s)
    select {KEY_SQL}, {R('fitted', 3)} as fitted, {R('residual', 3)} as residual, {R('leverage', 9)} as leverage,
    {R('residual / sqrt(v * (1 - leverage))', 5)} as std_residual from d""",
)
def _(spark, sf):
    df = rg.diagnostics(_li(spark, sf), "l_extendedprice", ["l_quantity"])
    return df.select(
        *KEY, rnd("fitted", 3).alias("fitted"), rnd("residual", 3).alias("residual"), rnd("leverage", 9).alias("leverage"),
        rnd("std_residual", 5).alias("std_residual"),
    )


@query("t16_partialling_out", ols2("lineitem", "l_extendedprice", "l_quantity", "l_discount") + f"select {R('b1', 5)} as slope from e")
def _(spark, sf):
    return rg.partial_out(_li(spark, sf), "l_extendedprice", "l_quantity", ["l_discount"]).select(rnd("slope", 5).alias("slope"))


@query("t22_logit")
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rg.logit(df, "quality", {"k_chars": F.col("n_chars") / 1000, "english": (F.col("lang") == "en").cast("int")})


@query("t22_logit_score", "select 0e0 as one, 0e0 as k_chars, 0e0 as english, count(*) as n from labels join documents using (doc_id)")
def _(spark, sf):
    """At the fit the residuals balance against every term."""
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    df = df.select("quality", F.lit(1.0).alias("one"), (F.col("n_chars") / 1000).alias("k_chars"), (F.col("lang") == "en").cast("int").alias("english"))
    coef = {r["term"]: r["coef"] for r in rg.logit(df, "quality", ["k_chars", "english"]).collect()}
    score = F.lit(coef["Intercept"]) + sum(F.lit(coef[x]) * F.col(x) for x in ("k_chars", "english"))
    left = F.col("quality") - 1 / (1 + F.exp(-score))
    sums = [rnd(F.sum(left * F.col(x)) / F.sum(F.abs(F.col(x))), 6).alias(x) for x in ("one", "k_chars", "english")]
    return df.agg(*sums, F.count("*").alias("n"))
