from pyspark.sql import functions as F

from tabulon.operators import windows as wn
from tabulon.queries.registry import R, day, query, rnd, table

LINE_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _daily(spark, sf):
    """Orders summed by day, with the day as text."""
    return (
        table(spark, sf, "orders")
        .groupBy(day("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    )


DAILY = "with d as (select strftime(o_orderdate, '%Y-%m-%d') as day, sum(o_totalprice) as total, count(*) as n from orders group by 1) "


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")


def _both(name, sql):
    """Register a query twice: with plain windows where they fit, and with the plan for hot keys forced."""

    def register(fn):
        query(name, sql)(lambda spark, sf: fn(spark, sf, None))
        query(f"{name}_hot", sql)(lambda spark, sf: fn(spark, sf, 0))
        return fn

    return register


@query(
    "w01_group_total",
    f"""select o_orderkey, {R('sum(o_totalprice) over (partition by o_custkey)', 2)} as total,
    {R('o_totalprice / sum(o_totalprice) over (partition by o_custkey)')} as share from orders""",
)
def _(spark, sf):
    df = wn.group_total(_orders(spark, sf), ["o_custkey"], "o_totalprice")
    return df.select("o_orderkey", rnd("total", 2).alias("total"), rnd("share").alias("share"))


@query("w02_group_mean", f"select o_orderkey, {R('avg(o_totalprice) over (partition by o_orderstatus)', 3)} as mean from orders")
def _(spark, sf):
    return wn.group_mean(_orders(spark, sf), ["o_orderstatus"], "o_totalprice").select("o_orderkey", rnd("mean", 3).alias("mean"))


@_both("w03_dense_rank", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() over (partition by l_suppkey order by l_quantity desc) as dense_rank from lineitem")
def _(spark, sf, hot):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return wn.dense_rank(df, ["l_suppkey"], "l_quantity", group_rows=hot).drop("l_quantity")


@_both(
    "w04_average_rank",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() over (partition by l_returnflag order by l_quantity desc)
    + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0e0 as avg_rank from lineitem""",
)
def _(spark, sf, hot):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return wn.avg_rank(df, ["l_returnflag"], "l_quantity", group_rows=hot).drop("l_quantity", "l_returnflag")


@_both(
    "w05_shift",
    DAILY + f"select day, {R('lag(total, 1) over (order by day)', 2)} as total_lag1, {R('lead(total, 2) over (order by day)', 2)} as total_lead2 from d",
)
def _(spark, sf, hot):
    df = wn.shift(_daily(spark, sf), "total", 1, ["day"], group_rows=hot)
    df = wn.shift(df, "total", -2, ["day"], group_rows=hot)
    return df.select("day", rnd("total_lag1", 2).alias("total_lag1"), rnd("total_lead2", 2).alias("total_lead2"))


@_both(
    "w06_rolling_mean_shifted",
    DAILY + f"""select day, case when count(total) over w = 2 then {R('avg(total) over w', 4)} end as mean2
    from d window w as (order by day rows between 2 preceding and 1 preceding)""",
)
def _(spark, sf, hot):
    df = wn.rolling(_daily(spark, sf), "total", 2, ["day"], fns=["avg"], shift=1, group_rows=hot)
    return df.select("day", rnd("total_avg2", 4).alias("mean2"))


@_both(
    "w07_rolling_min_mean_max",
    f"""select o_orderkey, case when count(*) over w = 3 then {R('min(o_totalprice) over w')} end as low,
    case when count(*) over w = 3 then {R('avg(o_totalprice) over w')} end as mean,
    case when count(*) over w = 3 then {R('max(o_totalprice) over w')} end as high
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)""",
)
def _(spark, sf, hot):
    df = wn.rolling(
        _orders(spark, sf), "o_totalprice", 3, ["o_orderdate", "o_orderkey"], ["o_custkey"], ["min", "avg", "max"], group_rows=hot
    )
    names = {"low": "min", "mean": "avg", "high": "max"}
    return df.select("o_orderkey", *[rnd(f"o_totalprice_{f}3").alias(n) for n, f in names.items()])


@_both(
    "w08_expanding",
    f"""select o_orderkey, {R('min(o_totalprice) over w')} as low, {R('avg(o_totalprice) over w')} as mean,
    {R('max(o_totalprice) over w')} as high, lead(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_value
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row)""",
)
def _(spark, sf, hot):
    df = wn.expanding(_orders(spark, sf), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"], "next_value", hot)
    names = {"low": "min", "mean": "mean", "high": "max"}
    return df.select("o_orderkey", "next_value", *[rnd(f"o_totalprice_{f}").alias(n) for n, f in names.items()])


@_both(
    "w09_trend_and_season",
    DAILY + f""", t as (select day, n, case when count(n) over w = 7 then avg(n) over w end as trend from d
    window w as (order by day rows between 6 preceding and current row)), s as (select *, n - trend as season from t)
    select day, {R('first_value(trend ignore nulls) over f')} as trend, {R('first_value(season ignore nulls) over f')} as season
    from s window f as (order by day rows between current row and unbounded following)""",
)
def _(spark, sf, hot):
    df = wn.seasonal(_daily(spark, sf), 7, ["n"], ["day"], group_rows=hot)
    return df.select("day", rnd("n_trend").alias("trend"), rnd("n_season").alias("season"))


@_both(
    "w10_factorize_in_group",
    """with f as (select *, min(event_id) over (partition by user_id, event_type) as f from events)
    select event_id, dense_rank() over (partition by user_id order by f) - 1 as code from f""",
)
def _(spark, sf, hot):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return wn.factorize_in_group(df, ["user_id"], "event_type", "event_id", group_rows=hot).select("event_id", "code")


ADSTOCK = """with d as (select event_type, strftime(ts, '%Y-%m-%d') as day, sum(value) as spend from events group by 1, 2),
r as (select *, row_number() over (partition by event_type order by day) as t from d)
select a.event_type, a.day, (round(sum(b.spend * power(0.6e0, a.t - b.t)), 4) + 0e0) as carried
from r a join r b on a.event_type = b.event_type and b.t <= a.t group by 1, 2"""


@_both("w11_adstock", ADSTOCK)
def _(spark, sf, hot):
    df = table(spark, sf, "events").groupBy("event_type", day("ts").alias("day")).agg(F.sum("value").alias("spend"))
    out = wn.adstock(df, {"spend": 0.6}, ["day"], ["event_type"], group_rows=hot)
    return out.select("event_type", "day", rnd("spend_adstock", 4).alias("carried"))


@_both(
    "w12_peaks_and_valleys",
    DAILY + """, w as (select day, n, lag(n) over (order by day) as a, lead(n) over (order by day) as b from d)
    select day, n, case when n > a and n > b then 'peak' else 'valley' end as turn from w where (n > a and n > b) or (n < a and n < b)""",
)
def _(spark, sf, hot):
    return wn.peaks(_daily(spark, sf), "n", ["day"], group_rows=hot).select("day", "n", "turn")


@query(
    "w12_sign_changes",
    DAILY + """, w as (select day, n, cast(sign(n - lag(n) over (order by day)) as double) as a, cast(sign(lead(n) over (order by day) - n) as double) as b from d)
    select day, n, b - a as change from w where b - a <> 0""",
)
def _(spark, sf):
    return wn.sign_changes(_daily(spark, sf), "n", ["day"]).select("day", "n", "change")


@_both(
    "w13_running_rate",
    f"""select event_id, count(*) over w as shown, cast(sum(case when event_type = 'click' then 1 else 0 end) over w as bigint) as hits,
    {R("avg(case when event_type = 'click' then 1.0 else 0.0 end) over w")} as rate from events
    window w as (partition by user_id % 2 order by event_id rows between unbounded preceding and current row)""",
)
def _(spark, sf, hot):
    df = table(spark, sf, "events").select("event_id", (F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "click").cast("int").alias("click"))
    out = wn.running_rate(df, "click", ["event_id"], ["arm"], hot)
    return out.select("event_id", "shown", "hits", rnd("rate").alias("rate"))


@query(
    "w14_demean",
    f"select o_orderkey, {R('o_totalprice - avg(o_totalprice) over (partition by o_custkey)')} as centred from orders",
)
def _(spark, sf):
    return wn.demean(_orders(spark, sf), ["o_custkey"], ["o_totalprice"]).select("o_orderkey", rnd("o_totalprice").alias("centred"))


@query(
    "w15_topk_per_group",
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r
    from orders) where r <= 3""",
)
def _(spark, sf):
    return wn.topk(_orders(spark, sf), ["o_custkey"], "o_totalprice", 3, ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@_both(
    "w16_row_ids",
    f"select {KEY_SQL}, row_number() over (order by l_shipdate, {KEY_SQL}) as row_id from lineitem",
)
def _(spark, sf, hot):
    return wn.with_row_id(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY, group_rows=hot).drop("l_shipdate")


@_both(
    "w17_autocorrelation",
    DAILY + ", c as (select day, n - avg(n) over () as d from d), l as (select d, "
    + ", ".join(f"lag(d, {k}) over (order by day) as l{k}" for k in range(1, 6)) + " from c) "
    + " union all ".join(
        f"select cast({k} as bigint) as lag, (round(sum(d * {'d' if k == 0 else f'l{k}'}) / sum(d * d), 6) + 0e0) as acf from l" for k in range(6)
    ),
)
def _(spark, sf, hot):
    df = wn.acf(_daily(spark, sf), "n", 5, ["day"], hot)
    return df.select("lag", rnd("acf").alias("acf"))


PACF = DAILY + """, c as (select day, n - avg(n) over () as d from d), l as (select d, lag(d, 1) over (order by day) as l1, lag(d, 2) over (order by day) as l2,
 lag(d, 3) over (order by day) as l3 from c), r as (select sum(d * l1) / sum(d * d) as r1, sum(d * l2) / sum(d * d) as r2, sum(d * l3) / sum(d * d) as r3 from l),
p as (select *, (r2 - r1 * r1) / (1 - r1 * r1) as p2 from r), q as (select *, r1 - p2 * r1 as f from p) """


@query(
    "w18_partial_autocorrelation",
    PACF + "select cast(0 as bigint) as lag, 1e0 as pacf union all " + " union all ".join(
        f"select cast({k} as bigint), {R(e)} from q" for k, e in ((1, "r1"), (2, "p2"), (3, "(r3 - f * r2 - p2 * r1) / (1 - f * r1 - p2 * r2)"))
    ),
)
def _(spark, sf):
    df = wn.pacf(_daily(spark, sf), "n", 3, ["day"])
    return df.select("lag", rnd("pacf").alias("pacf"))
