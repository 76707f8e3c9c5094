from pyspark.sql import functions as F

from tabulon.operators import regression as rg, stats as st
from tabulon.queries.registry import R, day, query, rnd, table

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(fn, name, d):
    return " union all ".join(
        f"select '{a}' as a, '{b}' as b, {R(f'{fn}({a}, {b})', d)} as {name} from lineitem" for a in COLS for b in COLS
    )


@query("t01_covariance", _matrix_sql("covar_samp", "cov", 4))
def _(spark, sf):
    return st.cov(table(spark, sf, "lineitem"), COLS).withColumn("cov", rnd("cov", 4))


@query("t02_correlation", _matrix_sql("corr", "corr", 8))
def _(spark, sf):
    return st.corr(table(spark, sf, "lineitem"), COLS).withColumn("corr", rnd("corr", 8))


@query(
    "t03_mean_interval",
    f"""select {R('avg(value)')} as mean, {R('stddev_pop(value) / sqrt(count(value))')} as se,
    {R('avg(value) - 2 * stddev_pop(value) / sqrt(count(value))')} as low, {R('avg(value) + 2 * stddev_pop(value) / sqrt(count(value))')} as high from events""",
)
def _(spark, sf):
    df = st.mean_interval(table(spark, sf, "events"), "value")
    return df.select(*[rnd(c).alias(c) for c in df.columns])


TTEST = f"""with s as (select count(value) filter (event_type = 'view') as na, count(value) filter (event_type = 'click') as nb,
 avg(value) filter (event_type = 'view') as ma, avg(value) filter (event_type = 'click') as mb,
 var_samp(value) filter (event_type = 'view') as va, var_samp(value) filter (event_type = 'click') as vb from events)
select {R('ma')} as mean_a, {R('mb')} as mean_b, {R('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb))')} as t,
 na + nb - 2 as dof from s"""


@query("t04_t_test", TTEST)
def _(spark, sf):
    df = st.ttest(table(spark, sf, "events"), "value", "event_type", "view", "click", "less")
    return df.select(rnd("mean_a").alias("mean_a"), rnd("mean_b").alias("mean_b"), rnd("t").alias("t"), "dof")


@query("t04_t_test_p_value")
def _(spark, sf):
    return st.ttest(table(spark, sf, "events"), "value", "event_type", "view", "click", "less").select("t", "dof", "p")


ANOVA = f"""with g as (select event_type, count(value) as n, avg(value) as m, var_samp(value) as v from events group by 1),
t as (select avg(value) as gm, count(value) as n from events)
select {R('(sum(g.n * power(m - gm, 2)) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - count(*)))')} as f,
 count(*) - 1 as dof_between, any_value(t.n) - count(*) as dof_within from g, t"""


@query("t05_anova", ANOVA)
def _(spark, sf):
    df = st.anova(table(spark, sf, "events"), "value", "event_type")
    return df.select(rnd("f").alias("f"), "dof_between", "dof_within")


@query("t05_anova_p_value")
def _(spark, sf):
    return st.anova(table(spark, sf, "events"), "value", "event_type")


CELLS = """with c as (select o_orderstatus, o_orderpriority, count(*) as observed from orders group by 1, 2),
e as (select *, sum(observed) over (partition by o_orderstatus) * sum(observed) over (partition by o_orderpriority) / sum(observed) over () as expected from c) """


@query("t06_chi_squared", CELLS + f"select {R('sum(power(observed - expected, 2) / expected)')} as chi2, cast(8 as bigint) as dof from e")
def _(spark, sf):
    return st.chi2(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(rnd("chi2").alias("chi2"), "dof")


@query("t06_chi_squared_p_value")
def _(spark, sf):
    return st.chi2(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("t06_chi_squared_cells", CELLS + f"select o_orderstatus, o_orderpriority, observed, {R('expected')} as expected from e")
def _(spark, sf):
    return st.chi2_cells(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("expected", rnd("expected"))


@query(
    "t06_chi_squared_yates",
    f"""with c as (select quality, toxic, count(*) as o from labels group by 1, 2),
    e as (select *, sum(o) over (partition by quality) * sum(o) over (partition by toxic) / sum(o) over () as e from c)
    select {R('sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e)')} as chi2, cast(1 as bigint) as dof from e""",
)
def _(spark, sf):
    return st.chi2(table(spark, sf, "labels"), "quality", "toxic").select(rnd("chi2").alias("chi2"), "dof")


@query(
    "t07_tukey",
    f"""with g as (select event_type, count(value) as n, avg(value) as m, var_samp(value) as v from events group by 1),
    e as (select sum((n - 1) * v) / (sum(n) - count(*)) as mse from g)
    select a.event_type as group1, b.event_type as group2, {R('b.m - a.m')} as diff, {R('abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n))')} as q
    from g a join g b on a.event_type < b.event_type, e""",
)
def _(spark, sf):
    df = st.tukey(table(spark, sf, "events"), "value", "event_type")
    return df.select("group1", "group2", rnd("diff").alias("diff"), rnd("q").alias("q"))


@query("t07_tukey_p_value")
def _(spark, sf):
    return st.tukey(table(spark, sf, "events"), "value", "event_type")


def _shares(spark, sf):
    """Daily shares of two event types."""
    d = table(spark, sf, "events").groupBy(day("ts").alias("day")).agg(
        F.count(F.when(F.col("event_type") == "view", 1)).cast("double").alias("p"),
        F.count(F.when(F.col("event_type") == "click", 1)).cast("double").alias("q"),
    )
    return d


SHARES = """with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'view') as p, count(*) filter (event_type = 'click') as q from events group by 1),
s as (select p / sum(p) over () as p, q / sum(q) over () as q from d) """


@query("t08_kl_divergence", SHARES.replace("s as (select p / sum(p) over () as p, q / sum(q) over () as q from d)", "s as (select p, q from d)")
       + f"select {R('sum(p * ln(p / q))', 4)} as kl from s where p > 0")
def _(spark, sf):
    return st.kl(_shares(spark, sf), "p", "q").select(rnd("kl", 4).alias("kl"))


@query(
    "t08_js_divergence",
    SHARES + f"select {R('sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) / 2 + sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2', 8)} as jsd from s",
)
def _(spark, sf):
    return st.jsd(_shares(spark, sf), "p", "q").select(rnd("jsd", 8).alias("jsd"))


@query(
    "t27_error_metrics",
    f"""select l_returnflag, {R('avg(power(l_extendedprice - 1500 * l_quantity, 2)) / 1e6')} as mse_m, {R('sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2)))')} as rmse,
    {R('avg(abs(l_extendedprice - 1500 * l_quantity))')} as mae, {R('avg(abs((l_extendedprice - 1500 * l_quantity) / l_extendedprice))')} as mape,
    {R('1 - avg(power(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice)')} as r2 from lineitem group by 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pred", 1500 * F.col("l_quantity"))
    df = rg.regression_metrics(li, "l_extendedprice", "pred", ["l_returnflag"])
    return df.select(
        "l_returnflag", rnd(F.col("mse") / 1e6).alias("mse_m"), *[rnd(c).alias(c) for c in ("rmse", "mae", "mape", "r2")]
    )


@query("m17_accuracy", f"select {R('avg(case when quality = (case when n_chars > 1000 then 1 else 0 end) then 1.0 else 0.0 end)')} as accuracy from labels join documents using (doc_id)")
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    df = df.withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    return rg.accuracy(df, "quality", "guess").select(rnd("accuracy").alias("accuracy"))
