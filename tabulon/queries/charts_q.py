from statistics import NormalDist

from pyspark.sql import functions as F

from tabulon.operators import charts as ch
from tabulon.operators.lowess import lowess
from tabulon.queries.registry import R, U, query, rnd, table

BINNED = """with r as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer),
b as (select c_mktsegment, c_acctbal, c_nationkey, lo, (hi - lo) / {n} as w, hi,
 cast(greatest(0, least({n} - 1, floor((c_acctbal - lo) / ((hi - lo) / {n})))) as bigint) as bin from customer, r) """


@query(
    "v01_histogram",
    BINNED.format(n=20) + f"select c_mktsegment, bin, {R('min(lo + bin * w)', 4)} as low, {R('min(lo + (bin + 1) * w)', 4)} as high, count(*) as n from b group by 1, 2",
)
def _(spark, sf):
    df = ch.histogram(table(spark, sf, "customer"), "c_acctbal", 20, ["c_mktsegment"])
    return df.withColumn("low", rnd("low", 4)).withColumn("high", rnd("high", 4))


@query(
    "v02_box_stats",
    f"""with q as (select event_type, quantile_cont(value, 0.25) as q1, median(value) as median, quantile_cont(value, 0.75) as q3 from events group by 1)
    select event_type, {R('any_value(q1)')} as q1, {R('any_value(median)')} as median, {R('any_value(q3)')} as q3,
    {R('min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))')} as low,
    {R('max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))')} as high,
    count(*) filter (not value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers
    from events join q using (event_type) group by 1""",
)
def _(spark, sf):
    df = ch.box_stats(table(spark, sf, "events"), "value", ["event_type"])
    return df.select("event_type", "outliers", *[rnd(c).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query("v03_category_count", "select p_type, count(*) as n, p_type || ': ' || count(*) as label from part group by 1")
def _(spark, sf):
    return ch.count_plot(table(spark, sf, "part"), "p_type")


@query(
    "v04_mean_interval_bars",
    f"""select o_orderpriority, {R('avg(o_totalprice)', 3)} as mean, {R('avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))', 3)} as low,
    {R('avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))', 3)} as high from orders group by 1""",
)
def _(spark, sf):
    df = ch.mean_ci(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return df.select("o_orderpriority", *[rnd(c, 3).alias(c) for c in ("mean", "low", "high")])


@query(
    "v04_bootstrap_interval_bars",
    f"""with w as (select o_orderpriority, r, o_totalprice as y, {U('o_orderkey', 'r', seed=3)} as u from orders, range(1, 101) t(r)),
    k as (select *, {" + ".join(f"(u >= {p!r})::int" for p in ch.POISSON_ONE)} as n from w),
    m as (select o_orderpriority, r, sum(n * y) / sum(n) as m from k group by 1, 2),
    e as (select o_orderpriority, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by 1)
    select o_orderpriority, {R('avg(o_totalprice)', 3)} as mean, {R('any_value(low)', 3)} as low, {R('any_value(high)', 3)} as high
    from orders join e using (o_orderpriority) group by 1""",
)
def _(spark, sf):
    df = ch.bootstrap_ci(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 100, 3)
    return df.select("o_orderpriority", *[rnd(c, 3).alias(c) for c in ("mean", "low", "high")])


@query(
    "v05_binned_mean",
    BINNED.format(n=15) + f"select bin, {R('avg(c_acctbal)', 4)} as x, {R('avg(c_nationkey)')} as y, count(c_nationkey) as n from b group by 1",
)
def _(spark, sf):
    df = ch.binned_mean(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", 15)
    return df.select("bin", rnd("x", 4).alias("x"), rnd("y").alias("y"), "n")


@query(
    "v06_kernel_density",
    f"""with r as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer),
    s as (select c_mktsegment, count(*) as total, stddev_samp(c_acctbal) * power(count(*), -0.2) as h from customer group by 1),
    g as (select c_mktsegment, c_acctbal, total, h, lo, hi, unnest(range(30)) as point from customer join s using (c_mktsegment), r)
    select c_mktsegment, point, {R('min(lo + point * (hi - lo) / 29)', 4)} as x,
    {R('sum(exp(-0.5 * power((lo + point * (hi - lo) / 29 - c_acctbal) / h, 2))) / (any_value(total) * any_value(h) * sqrt(2 * pi()))', 9)} as density from g group by 1, 2""",
)
def _(spark, sf):
    df = ch.kde(table(spark, sf, "customer"), "c_acctbal", 30, ["c_mktsegment"], per_width=None)
    return df.select("c_mktsegment", "point", rnd("x", 4).alias("x"), rnd("density", 9).alias("density"))


PROBS = [(i - 0.5) / 50 for i in range(1, 51)]
QQ = "with p(prob, theoretical) as (values " + ", ".join(f"({p!r}::double, {NormalDist().inv_cdf(p)!r}::double)" for p in PROBS) + ") "


@query(
    "v07_normal_qq",
    QQ + f", q as (select unnest({PROBS}::double[]) as prob, unnest(quantile_cont(c_acctbal, {PROBS})) as sample from customer) "
    + f"select {R('prob', 3)} as prob, {R('theoretical', 8)} as theoretical, {R('sample')} as sample from p join q using (prob)",
)
def _(spark, sf):
    df = ch.qq(table(spark, sf, "customer"), "c_acctbal", 50)
    return df.select(rnd("prob", 3).alias("prob"), rnd("theoretical", 8).alias("theoretical"), rnd("sample").alias("sample"))


SMOOTH = f"""with r as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem),
b as (select greatest(0, least(39, floor((l_quantity - lo) / ((hi - lo) / 40)))) as bin, avg(l_quantity) as x, avg(l_extendedprice) as y, count(*) as n from lineitem, r group by 1),
g as (select point, lo + (point + 0.5) * (hi - lo) / 40 as mid, 0.3 * (hi - lo) as span from r, range(40) t(point)),
w as (select point, mid, x - mid as d, y, power(1 - power(abs(x - mid) / span, 3), 3) * n as w from g, b where abs(x - mid) < span),
s as (select point, mid, sum(w) as s0, sum(w * d) as s1, sum(w * d * d) as s2, sum(w * y) as t0, sum(w * d * y) as t1 from w group by 1, 2)
select point, {R('mid')} as x, {R('(s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)', 4)} as trend from s"""


@query("v08_smooth_trend", SMOOTH)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return ch.smooth(li, "l_quantity", "l_extendedprice", 40, 0.3).select("point", rnd("x").alias("x"), rnd("trend", 4).alias("trend"))


PROFILED = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query(
    "v09_profile",
    " union all ".join(f"""select '{c}' as "column", '{t}' as type, count(*) as n_rows, count({c}) as n_present from documents left join labels using (doc_id)""" for c, t in PROFILED.items()),
)
def _(spark, sf):
    return ch.profile(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"))


def _lowess_sql(table_: str, x: str, y: str, share: float, rounds: int, anchors: int) -> str:
    """Nearest rows by rank of distance, local lines, medians and bisquare weights, round by round."""
    head = f"""r as (select row_number() over (order by {x}, {y}) as id, {x}::double as x, {y}::double as y from {table_} where {x} is not null and {y} is not null),
    total as (select count(*) as n from r),
    a as (select distinct x as spot from (select x, row_number() over (order by x) as k from r)
      where k in (select 1 + cast(round_even(g * (n - 1) / {anchors - 1}.0::double, 0) as bigint) from total, range({anchors}) as t(g))),
    h as (select spot, d as h from (select spot, abs(x - spot) as d, row_number() over (partition by spot order by abs(x - spot)) as k from a, r), total where k = ceil({share}::double * n)),
    w0 as (select id, 1::double as w from r)"""
    for k in range(rounds + 1):
        head += f""",
    s{k} as (select spot, sum(v) as s0, sum(v * z) as s1, sum(v * z * z) as s2, sum(v * y) as t0, sum(v * z * y) as t1 from (
      select spot, (x - spot) / h as z, y, w * power(1 - power(abs(x - spot) / h, 3), 3) as v from h, r join w{k} using (id) where abs(x - spot) < h) group by spot),
    f{k} as (select spot, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) as trend from s{k})"""
        if k < rounds:
            head += f""",
    g{k} as (select spot, trend, lead(spot) over (order by spot) as spot1, lead(trend) over (order by spot) as trend1 from f{k}),
    e{k} as (select id, abs(y - (trend + (trend1 - trend) * (x - spot) / (spot1 - spot))) as e from r join g{k} on spot1 is not null and x >= spot
      and (x < spot1 or spot1 = (select max(spot) from a))),
    w{k + 1} as (select id, case when e < 6 * m then power(1 - power(e / (6 * m), 2), 2) else 0 end as w from e{k}, (select median(e) as m from e{k}))"""
    return f"with {head} select {R('spot', 4)} as x, {R('trend', 4)} as trend, {R('h', 4)} as width from f{rounds} join h using (spot)"


@query("v08_robust_trend", _lowess_sql("customer", "c_acctbal", "c_nationkey + c_acctbal / 1000 + c_custkey % 7", 0.25, 2, 30))
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_acctbal", (F.col("c_nationkey") + F.col("c_acctbal") / 1000 + F.col("c_custkey") % 7).alias("y"))
    out = lowess(c, "c_acctbal", "y", 0.25, 2, 30)
    return out.select(rnd("x", 4).alias("x"), rnd("trend", 4).alias("trend"), rnd("width", 4).alias("width"))
