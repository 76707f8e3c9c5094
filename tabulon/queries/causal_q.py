import datetime

from pyspark.sql import functions as F

from tabulon.functions.scalars import digitize
from tabulon.operators import causal as cs, regression as rg
from tabulon.operators.segments import grown_segments
from tabulon.queries.registry import R, U, query, rnd, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEY)


def _orders_customer(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(c, "o_custkey")


@query(
    "t17_difference_in_differences",
    f"""with m as (select avg(o_totalprice) filter (t and p) as t1, avg(o_totalprice) filter (t and not p) as t0, avg(o_totalprice) filter (not t and p) as c1,
    avg(o_totalprice) filter (not t and not p) as c0 from (select o_totalprice, c_mktsegment = 'BUILDING' as t, o_orderdate >= timestamp '1998-01-01' as p
    from orders join customer on o_custkey = c_custkey))
    select {R('t1', 4)} as t1, {R('t0', 4)} as t0, {R('c1', 4)} as c1, {R('c0', 4)} as c0, {R('t0 + c1 - c0', 4)} as counterfactual, {R('t1 - t0 - (c1 - c0)', 4)} as effect from m""",
)
def _(spark, sf):
    post = F.col("o_orderdate") >= F.lit(datetime.datetime(1998, 1, 1))
    df = cs.did(_orders_customer(spark, sf), "o_totalprice", F.col("c_mktsegment") == "BUILDING", post)
    return df.select(*[rnd(c, 4).alias(c) for c in df.columns])


def _panel(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.log(F.sum("o_totalprice")).alias("y"), F.count("*").cast("double").alias("n_orders"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"),
    )


PANEL = """with p as (select o_custkey, year(o_orderdate) as year, ln(sum(o_totalprice)) as y, cast(count(*) as double) as n_orders,
 avg(case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end) as urgent from orders group by 1, 2),
d as (select y - avg(y) over w as y, n_orders - avg(n_orders) over w as x1, urgent - avg(urgent) over w as x2 from p window w as (partition by o_custkey)),
s as (select sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as c, sum(x1 * y) as p, sum(x2 * y) as q from d) """


@query(
    "t18_fixed_effects",
    PANEL + f"select 'n_orders' as term, {R('(c * p - b * q) / (a * c - b * b)')} as coef from s union all select 'urgent', {R('(a * q - b * p) / (a * c - b * b)')} from s",
)
def _(spark, sf):
    fit = cs.fixed_effects(_panel(spark, sf), "y", ["n_orders", "urgent"], "o_custkey")
    return fit.table(spark).select("term", rnd("coef").alias("coef"))


CLUSTERED = PANEL.replace("d as (select y", "d as (select o_custkey, y") + f""", b as (select *, (c * p - b * q) / (a * c - b * b) as b1, (a * q - b * p) / (a * c - b * b) as b2, a * c - b * b as det from s),
g as (select o_custkey, sum(x1 * (y - b1 * x1 - b2 * x2)) as s1, sum(x2 * (y - b1 * x1 - b2 * x2)) as s2 from d, b group by 1),
m as (select sum(s1 * s1) as m11, sum(s1 * s2) as m12, sum(s2 * s2) as m22 from g), n as (select count(*) as n from d)
select 'n_orders' as term, {R('b1')} as coef, {R('sqrt((c * c * m11 - 2 * b * c * m12 + b * b * m22) / (det * det) * n / (n - 2))')} as se from b, m, n
union all select 'urgent', {R('b2')}, {R('sqrt((b * b * m11 - 2 * a * b * m12 + a * a * m22) / (det * det) * n / (n - 2))')} from b, m, n"""


@query("t19_clustered_errors", CLUSTERED.replace("n / (n - 2)", "n.n / (n.n - 2)"))
def _(spark, sf):
    df = cs.clustered(_panel(spark, sf), "y", ["n_orders", "urgent"], "o_custkey")
    return df.select("term", rnd("coef").alias("coef"), rnd("se").alias("se"))


@query("t19_clustered_errors_p_value")
def _(spark, sf):
    return cs.clustered(_panel(spark, sf), "y", ["n_orders", "urgent"], "o_custkey")


@query("t20_two_way_effects")
def _(spark, sf):
    return cs.clustered(_panel(spark, sf), "y", ["n_orders", "urgent"], "o_custkey", "year")


@query(
    "t21_within_variation",
    f"""with g as (select o_custkey, stddev_samp(o_totalprice) as a, stddev_samp(c_acctbal) as b from orders join customer on o_custkey = c_custkey group by 1)
    select {R('sum(a)', 2)} as o_totalprice, {R('sum(b)', 2)} as c_acctbal from g""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    df = cs.within_variation(table(spark, sf, "orders").join(c, "o_custkey"), ["o_custkey"], ["o_totalprice", "c_acctbal"])
    return df.select(rnd("o_totalprice", 2).alias("o_totalprice"), rnd("c_acctbal", 2).alias("c_acctbal"))


@query(
    "t23_pretest_models",
    f"""with s as (select l_suppkey, covar_pop(l_quantity, l_quantity) as dd, covar_pop(l_discount, l_discount) as xx, covar_pop(l_quantity, l_discount) as dx,
    covar_pop(l_quantity, l_extendedprice) as dy, covar_pop(l_discount, l_extendedprice) as xy from lineitem group by 1)
    select l_suppkey, {R('(xx * dy - dx * xy) / (dd * xx - dx * dx)', 4)} as long, {R('dy / dd', 4)} as short from s""",
)
def _(spark, sf):
    df = cs.pretest(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_suppkey"])
    return df.select("l_suppkey", rnd("long", 4).alias("long"), rnd("short", 4).alias("short"))


@query("t23_pretest")
def _(spark, sf):
    return cs.pretest(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_suppkey"])


@query(
    "t24_omitted_variable_bias",
    f"""select {R('covar_samp(l_discount, l_extendedprice) / var_samp(l_discount)', 4)} as beta, {R('covar_samp(l_quantity, l_discount) / var_samp(l_quantity)', 9)} as delta,
    {R('covar_samp(l_discount, l_extendedprice) / var_samp(l_discount) * covar_samp(l_quantity, l_discount) / var_samp(l_quantity)')} as ovb from lineitem""",
)
def _(spark, sf):
    df = cs.ovb(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return df.select(rnd("beta", 4).alias("beta"), rnd("delta", 9).alias("delta"), rnd("ovb").alias("ovb"))


def _elastic(spark, sf):
    li = table(spark, sf, "lineitem")
    c = rg.categorical(li, "l_linestatus", ["F", "O"])
    x, moved = rg.numeric("l_quantity"), {"l_quantity": F.col("l_quantity") + 1}
    terms = {**x, **c, **rg.interact(x, c)}
    fit = rg.ols(li, "l_extendedprice", terms)
    shifted = {**moved, **c, **rg.interact(moved, c)}
    return li.withColumn("prediction", fit.predict(terms)).withColumn("elasticity", cs.elasticity(fit, terms, shifted))


ELASTIC = "with m as (select l_linestatus, regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as c from lineitem group by 1) "


@query("t25_elasticity", ELASTIC + f"select {KEY_SQL}, {R('s', 3)} as elasticity from lineitem join m using (l_linestatus)")
def _(spark, sf):
    return _elastic(spark, sf).select(*KEY, rnd("elasticity", 3).alias("elasticity"))


@query(
    "t26_bands",
    """with e as (select quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]) as q, quantile_cont(c_custkey, [0.0, 0.25, 0.5, 0.75, 1.0]) as r from customer)
    select case when c_acctbal <= q[2] then 1 when c_acctbal <= q[3] then 2 when c_acctbal <= q[4] then 3 else 4 end as c_acctbal_band,
    case when c_custkey <= r[2] then 1 when c_custkey <= r[3] then 2 when c_custkey <= r[4] then 3 else 4 end as c_custkey_band, count(*) as n from customer, e group by 1, 2""",
)
def _(spark, sf):
    df = cs.bands(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 4)
    return df.groupBy("c_acctbal_band", "c_custkey_band").agg(F.count("*").alias("n"))


@query(
    "t28_policy_value",
    f"select {R('sum(case when l_discount < 0.03 then l_extendedprice * l_discount else 0 end) / count(*)', 4)} as value from lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("gain", F.col("l_extendedprice") * F.col("l_discount"))
    return cs.policy_value(li, F.col("l_discount") < 0.03, "gain").select(rnd("value", 4).alias("value"))


@query(
    "t29_best_arm_per_band",
    """with b as (select c_custkey, c_mktsegment, c_acctbal, greatest(1, least(3, cast(c_acctbal >= -1000 as integer) + cast(c_acctbal >= 1000 as integer)
     + cast(c_acctbal >= 5000 as integer) + cast(c_acctbal >= 10000 as integer))) as band from customer),
    m as (select band, c_mktsegment, avg(c_acctbal) as m from b group by 1, 2),
    r as (select band, c_mktsegment as best, rank() over (partition by band order by m desc) + (count(*) over (partition by band, m) - 1) / 2.0 as r from m)
    select c_custkey, band, best from b join r using (band) where r = 1""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").withColumn("band", digitize("c_acctbal", [-1000, 1000, 5000, 10000]))
    return cs.best_per_band(df, "band", "c_mktsegment", "c_acctbal").select("c_custkey", "band", "best")


def _tee(spark, sf):
    return table(spark, sf, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("int"))


def _residual_sql(y: str, t: str, xs: tuple[str, str], seed: int, keep: str = "") -> str:
    """Out-of-fold residuals (ry, rt) on two controls, by the closed form of two regressors."""
    x, z = xs
    one = lambda v: f"covar_pop({v}, x) as cx_{v}, covar_pop({v}, z) as cz_{v}, avg({v}) as m_{v}"
    b1 = lambda v: f"((czz * cx_{v} - cxz * cz_{v}) / (cxx * czz - cxz * cxz))"
    b2 = lambda v: f"((cxx * cz_{v} - cxz * cx_{v}) / (cxx * czz - cxz * cxz))"
    rest = lambda v: f"({v} - m_{v} - {b1(v)} * (x - mx) - {b2(v)} * (z - mz))"
    source = "(select *, cast(l_linestatus = 'O' as int) as open from lineitem)"
    return f"""(select {keep} {rest('y')} as ry, {rest('t')} as rt from (select *, {y} as y, {t} as t, {x} as x, {z} as z, cast(floor({U(*KEY, seed=seed)} * 5) as int) as fold from {source}) as u
      join (select f.fold, avg(x) as mx, avg(z) as mz, var_pop(x) as cxx, var_pop(z) as czz, covar_pop(x, z) as cxz, {one('y')}, {one('t')}
        from (select distinct cast(floor({U(*KEY, seed=seed)} * 5) as int) as fold from lineitem) as f
        join (select {y} as y, {t} as t, {x} as x, {z} as z, cast(floor({U(*KEY, seed=seed)} * 5) as int) as fold from {source}) as o on o.fold <> f.fold group by f.fold) using (fold))"""


def _slope_sql(pairs: str, by: str = "") -> str:
    group = f"group by {by}" if by else ""
    by = f"{by}, " if by else ""
    return f"""(select {by}n, ty / tt as effect, sqrt(a - 2 * (ty / tt) * b + (ty / tt) * (ty / tt) * c) / tt as se from (
      select {by}count(*) as n, sum(rt * ry) as ty, sum(rt * rt) as tt, sum(power(rt * ry, 2)) as a, sum(power(rt, 3) * ry) as b, sum(power(rt, 4)) as c from {pairs} {group}))"""


@query(
    "t30_effects_of_one_treatment",
    f"select 'l_quantity' as treatment, {R('effect', 4)} as effect, {R('se', 4)} as se, n from "
    + _slope_sql(_residual_sql("l_extendedprice", "l_quantity", ("l_discount", "l_tax"), 123)),
)
def _(spark, sf):
    out = cs.treatment_effects(_tee(spark, sf), "l_extendedprice", ["l_quantity"], ["l_discount", "l_tax"], 5, 123, KEY)
    return out.select("treatment", rnd("effect", 4).alias("effect"), rnd("se", 4).alias("se"), "n")


@query(
    "t31_effect_by_return_flag",
    f"select l_returnflag, {R('effect', 4)} as effect, {R('se', 4)} as se, n from "
    + _slope_sql(_residual_sql("l_extendedprice", "l_quantity", ("l_discount", "l_tax"), 123, "l_returnflag,"), "l_returnflag"),
)
def _(spark, sf):
    out = cs.effect_by_segment(_tee(spark, sf), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], ["l_returnflag"], 5, 123, KEY)
    return out.select("l_returnflag", rnd("effect", 4).alias("effect"), rnd("se", 4).alias("se"), "n")


@query("t30_double_residual_effects")
def _(spark, sf):
    return cs.treatment_effects(_tee(spark, sf), "l_extendedprice", ["l_quantity", "open"], ["l_discount", "l_tax"], 5, 123, KEY)


@query("t31_effect_by_segment")
def _(spark, sf):
    return cs.effect_by_segment(_tee(spark, sf), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], ["l_returnflag"], 5, 123, KEY)


@query(
    "t32_individual_policy",
    f"""with e as (select c_custkey, c_acctbal / 100 as effect from customer)
    select c_custkey, 1 as treat, {R('effect - 20')} as net from e where effect > 20 order by effect - 20 desc, c_custkey limit 100""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("effect"))
    return cs.policy(df, "effect", 20.0, 100, ["c_custkey"]).select("c_custkey", "treat", rnd("net").alias("net"))


@query(
    "t33_what_if",
    f"""select {R('avg(l_extendedprice)', 4)} as now, {R('avg(l_extendedprice + 250 * l_tax)', 4)} as treated,
    {R('avg(l_extendedprice + 250 * l_tax) - avg(l_extendedprice)', 4)} as shift from lineitem where l_discount = 0""",
)
def _(spark, sf):
    df = cs.what_if(table(spark, sf, "lineitem"), F.col("l_discount") == 0, "l_extendedprice", 250 * F.col("l_tax"))
    return df.select(*[rnd(c, 4).alias(c) for c in df.columns])


# Residuals on one control across folds, the moments of every value as running sums, and the best split of each node.
GROWN = f"""with u as (select *, cast(floor({U(*KEY, seed=7)} * 5) as int) as fold, {U(*KEY, seed=8)} < 0.5 as grows from lineitem),
fits as (select f.fold, regr_slope(l_extendedprice, l_tax) as sy, regr_intercept(l_extendedprice, l_tax) as iy, regr_slope(l_quantity, l_tax) as st,
  regr_intercept(l_quantity, l_tax) as it from (select distinct fold from u) as f join u on u.fold <> f.fold group by f.fold),
pairs as (select grows, l_discount, l_shipdate, cast(l_suppkey as double) as l_suppkey, l_extendedprice - iy - sy * l_tax as ry, l_quantity - it - st * l_tax as rt from u join fits using (fold)),
grid as (select *, case when grows then 1 end as g from pairs),
{{level1}},
{{level2}}
select node, {R('effect', 4)} as effect, {R('sqrt(meat) / tt', 4)} as se, n from (
  select node, n, tt, ty / tt as effect, a - 2 * (ty / tt) * b + (ty / tt) * (ty / tt) * c as meat from (
    select node, count(*) as n, sum(rt * ry) as ty, sum(rt * rt) as tt, sum(power(rt * ry, 2)) as a, sum(power(rt, 3) * ry) as b, sum(power(rt, 4)) as c
    from nodes2 where not grows group by node))"""


def _level(k: int, source: str) -> str:
    return f"""cells{k} as (select node, f, v, sum(rt * ry) as ty, sum(rt * rt) as tt, count(*) as n from (
    select node, rt, ry, unnest(['l_discount', 'l_suppkey']) as f, unnest([l_discount, l_suppkey]) as v from {source} where grows) group by all),
  runs{k} as (select *, sum(ty) over w as lty, sum(tt) over w as ltt, sum(n) over w as ln, sum(ty) over a as aty, sum(tt) over a as att, sum(n) over a as an
    from cells{k} window w as (partition by node, f order by v), a as (partition by node, f)),
  best{k} as (select node, f, v from runs{k} where least(ln, an - ln) >= 50 and lty * lty / ltt + (aty - lty) * (aty - lty) / (att - ltt) > aty * aty / att
    qualify row_number() over (partition by node order by lty * lty / ltt + (aty - lty) * (aty - lty) / (att - ltt) - aty * aty / att desc, f, v) = 1),
  nodes{k} as (select s.* exclude (node), case when b.f is null then s.node when case b.f when 'l_discount' then l_discount else l_suppkey end <= b.v then 2 * s.node else 2 * s.node + 1 end as node
    from {source} as s left join best{k} as b on s.node = b.node)"""


@query("t31_grown_segments", GROWN.format(level1="nodes0 as (select *, 1 as node from grid), " + _level(1, "nodes0"), level2=_level(2, "nodes1")))
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = grown_segments(df, "l_extendedprice", "l_quantity", ["l_tax"], ["l_discount", "l_suppkey"], 2, 5, 7, KEY, bins=128)
    return out.select("node", rnd("effect", 4).alias("effect"), rnd("se", 4).alias("se"), "n")
