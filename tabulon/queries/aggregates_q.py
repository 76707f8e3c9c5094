from pyspark.sql import functions as F

from tabulon.operators import aggregates as ag
from tabulon.queries.registry import R, day, query, rnd, table


def _li(spark, sf, *cols):
    return table(spark, sf, "lineitem").select(*cols)


@query("a01_group_mean", f"select l_returnflag, {R('avg(l_quantity)')} as mean_quantity from lineitem group by 1")
def _(spark, sf):
    df = ag.agg(_li(spark, sf, "l_returnflag", "l_quantity"), ["l_returnflag"], {"mean_quantity": ("avg", "l_quantity")})
    return df.withColumn("mean_quantity", rnd("mean_quantity"))


@query(
    "a02_group_several_keys",
    f"""select l_returnflag, l_linestatus, l_suppkey, {R('avg(l_discount)')} as mean_discount, {R('max(l_quantity)')} as top
    from lineitem group by all""",
)
def _(spark, sf):
    df = ag.agg(
        _li(spark, sf, "l_returnflag", "l_linestatus", "l_suppkey", "l_discount", "l_quantity"),
        ["l_returnflag", "l_linestatus", "l_suppkey"],
        {"mean_discount": ("avg", "l_discount"), "top": ("max", "l_quantity")},
    )
    return df.withColumn("mean_discount", rnd("mean_discount")).withColumn("top", rnd("top"))


@query("a03_group_sum", f"select l_suppkey, {R('sum(l_extendedprice)', 2)} as total from lineitem group by 1")
def _(spark, sf):
    df = ag.agg(_li(spark, sf, "l_suppkey", "l_extendedprice"), ["l_suppkey"], {"total": ("sum", "l_extendedprice")})
    return df.withColumn("total", rnd("total", 2))


@query(
    "a04_group_size",
    "select lang, count(*) as n, count(quality) as labelled from documents left join labels using (doc_id) group by 1",
)
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return ag.agg(df, ["lang"], {"n": ("count", "doc_id"), "labelled": ("count", "quality")})


@query(
    "a05_several_functions",
    f"""select event_type, {R('sum(value)', 4)} as value_sum, {R('avg(value)')} as value_avg, {R('stddev_samp(value)')} as value_std
    from events group by 1""",
)
def _(spark, sf):
    df = ag.agg_many(table(spark, sf, "events"), ["event_type"], "value", ["sum", "avg", "std"])
    return df.select("event_type", rnd("value_sum", 4).alias("value_sum"), rnd("value_avg").alias("value_avg"), rnd("value_std").alias("value_std"))


@query(
    "a06_named_aggregates",
    f"""select l_partkey, {R('avg(l_quantity)')} as mean_rating, count(l_quantity) as number_of_ratings from lineitem group by 1""",
)
def _(spark, sf):
    df = ag.agg(
        _li(spark, sf, "l_partkey", "l_quantity"), ["l_partkey"],
        {"mean_rating": ("avg", "l_quantity"), "number_of_ratings": ("count", "l_quantity")},
    )
    return df.withColumn("mean_rating", rnd("mean_rating"))


@query(
    "a07_sample_std_var",
    f"""select o_orderpriority, {R('stddev_samp(o_totalprice)', 4)} as std, {R('var_samp(o_totalprice) / 1e6', 4)} as var_m
    from orders group by 1""",
)
def _(spark, sf):
    df = ag.agg(table(spark, sf, "orders"), ["o_orderpriority"], {"std": ("std", "o_totalprice"), "v": ("var", "o_totalprice")})
    return df.select("o_orderpriority", rnd("std", 4).alias("std"), rnd(F.col("v") / 1e6, 4).alias("var_m"))


@query("a08_population_std", f"select c_mktsegment, {R('stddev_pop(c_acctbal)')} as std from customer group by 1")
def _(spark, sf):
    df = ag.agg(table(spark, sf, "customer"), ["c_mktsegment"], {"std": ("std_pop", "c_acctbal")})
    return df.withColumn("std", rnd("std"))


@query("a09_count_distinct", "select l_returnflag, count(distinct l_partkey) as n_unique from lineitem group by 1")
def _(spark, sf):
    return ag.nunique(_li(spark, sf, "l_returnflag", "l_partkey"), "l_partkey", ["l_returnflag"])


@query(
    "a10_value_counts",
    f"select event_type, count(*) as n, {R('count(*) / sum(count(*)) over ()')} as fraction from events group by 1",
)
def _(spark, sf):
    df = ag.value_counts(table(spark, sf, "events"), "event_type", normalize=True)
    return df.withColumn("fraction", rnd("fraction"))


SETS = """select o_custkey, cast((rn - 1) // {p} as bigint) as part, string_agg(p_brand, ',' order by p_brand) as brands from
 (select o_custkey, p_brand, row_number() over (partition by o_custkey order by p_brand) as rn from
  (select distinct o_custkey, p_brand from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey))
group by all"""


def _brands(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return _li(spark, sf, "l_orderkey", "l_partkey").join(orders, "l_orderkey").join(part, "l_partkey")


@query("a11_collect_set", SETS.format(p=100000))
def _(spark, sf):
    df = ag.collect_groups(_brands(spark, sf), ["o_custkey"], "p_brand")
    return df.select("o_custkey", "part", F.array_join("p_brand", ",").alias("brands"))


@query("a11_collect_set_hot", SETS.format(p=10))
def _(spark, sf):
    df = ag.collect_groups(_brands(spark, sf), ["o_custkey"], "p_brand", part_rows=10, group_rows=0)
    return df.select("o_custkey", "part", F.array_join("p_brand", ",").alias("brands"))


@query(
    "a12_collect_ordered",
    """select l_orderkey, cast(0 as bigint) as part, string_agg(l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) as items
    from lineitem group by 1""",
)
def _(spark, sf):
    df = ag.collect_ordered(
        _li(spark, sf, "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"), ["l_orderkey"], "l_partkey",
        ["l_linenumber", "l_partkey", "l_suppkey"],
    )
    return df.select("l_orderkey", "part", F.array_join(F.col("l_partkey").cast("array<string>"), ",").alias("items"))


QUANT = " union all ".join(
    f"select l_returnflag, cast({p} as double) as prob, {R(f'quantile_cont(l_extendedprice, {p})', 4)} as value from lineitem group by 1"
    for p in (0.05, 0.5, 0.99)
)


@query("a13_quantiles", QUANT)
def _(spark, sf):
    df = ag.quantiles(_li(spark, sf, "l_returnflag", "l_extendedprice"), "l_extendedprice", [0.05, 0.5, 0.99], ["l_returnflag"])
    return df.withColumn("value", rnd("value", 4))


@query("a13_quantiles_many_values", QUANT)
def _(spark, sf):
    df = ag.quantiles(
        _li(spark, sf, "l_returnflag", "l_extendedprice"), "l_extendedprice", [0.05, 0.5, 0.99], ["l_returnflag"],
        distinct_values=0, group_rows=0,
    )
    return df.withColumn("value", rnd("value", 4))


@query(
    "a14_describe",
    " union all ".join(
        f"select '{c}' as variable, '{s}' as stat, {R(e.format(c=c), 4)} as value from lineitem"
        for c in ("l_quantity", "l_discount")
        for s, e in {
            "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
            "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "95%": "quantile_cont({c}, 0.95)",
        }.items()
    ),
)
def _(spark, sf):
    df = ag.describe(_li(spark, sf, "l_quantity", "l_discount"), ["l_quantity", "l_discount"], [0.25, 0.5, 0.95])
    return df.withColumn("value", rnd("value", 4))


@query("a15_median", f"select {R('median(c_acctbal)', 4)} as median from customer")
def _(spark, sf):
    return ag.median(table(spark, sf, "customer"), "c_acctbal").select(rnd("median", 4).alias("median"))


@query(
    "a16_mode",
    "select l_quantity, n from (select l_quantity, count(*) as n, rank() over (order by count(*) desc) as r from lineitem group by 1) where r = 1",
)
def _(spark, sf):
    return ag.mode(_li(spark, sf, "l_quantity"), "l_quantity")


@query("a17_skewness", f"select event_type, {R('skewness(value)')} as skew from events group by 1")
def _(spark, sf):
    df = ag.skew(table(spark, sf, "events"), "value", ["event_type"])
    return df.withColumn("skew", rnd("skew"))


@query(
    "a18_interquartile_range",
    f"select {R('quantile_cont(o_totalprice, 0.25)', 4)} as q1, {R('quantile_cont(o_totalprice, 0.75)', 4)} as q3, {R('quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)', 4)} as iqr from orders",
)
def _(spark, sf):
    df = ag.iqr(table(spark, sf, "orders"), "o_totalprice")
    return df.select(*[rnd(c, 4).alias(c) for c in ("q1", "q3", "iqr")])


@query("a19_group_min_max", "select p_brand, min(p_retailprice) as low, max(p_retailprice) as high from part group by 1")
def _(spark, sf):
    return ag.agg(table(spark, sf, "part"), ["p_brand"], {"low": ("min", "p_retailprice"), "high": ("max", "p_retailprice")})


@query(
    "a20_sum_all_columns",
    f"select l_returnflag, l_linestatus, {R('sum(l_quantity)', 2)} as l_quantity, {R('sum(l_tax)', 2)} as l_tax from lineitem group by 1, 2",
)
def _(spark, sf):
    df = ag.sum_all(_li(spark, sf, "l_returnflag", "l_linestatus", "l_quantity", "l_tax"), ["l_returnflag", "l_linestatus"])
    return df.withColumn("l_quantity", rnd("l_quantity", 2)).withColumn("l_tax", rnd("l_tax", 2))


@query("a21_having", "select l_partkey, count(*) as n from lineitem group by 1 having count(*) > 35")
def _(spark, sf):
    return ag.having(_li(spark, sf, "l_partkey"), ["l_partkey"], F.count("*").alias("n"), F.col("n") > 35)


@query(
    "a22_segment_rates",
    f"""select o_orderpriority, coalesce(c_mktsegment, 'all') as segment, case when grouping(c_mktsegment) = 1 then 'overall' else 'segment' end as level,
    count(*) as n, {R("avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end)")} as rate
    from orders join customer on o_custkey = c_custkey group by grouping sets ((1, c_mktsegment), (1))""".replace("((1, c_mktsegment), (1))", "((o_orderpriority, c_mktsegment), (o_orderpriority))"),
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("done")
    )
    df = orders.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    out = ag.segment_rates(df, "o_orderpriority", "c_mktsegment", "done")
    return out.select(
        "o_orderpriority", F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "level", "n", rnd("rate").alias("rate")
    )


@query(
    "a23_share_of_total",
    f"select l_suppkey, {R('sum(l_extendedprice) / sum(sum(l_extendedprice)) over ()', 8)} as share from lineitem group by 1",
)
def _(spark, sf):
    df = ag.share(_li(spark, sf, "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice")
    return df.withColumn("share", rnd("share", 8))


@query(
    "a24_conditional_means",
    f"""select {R("avg(case when o_orderstatus = 'F' then o_totalprice end)", 4)} as finished,
    {R("avg(case when o_orderpriority = '1-URGENT' then o_totalprice end)", 4)} as urgent from orders""",
)
def _(spark, sf):
    df = ag.cond_avg(
        table(spark, sf, "orders"),
        {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"}, "o_totalprice",
    )
    return df.select(rnd("finished", 4).alias("finished"), rnd("urgent", 4).alias("urgent"))


@query(
    "a25_crosstab",
    """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
    count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
)
def _(spark, sf):
    return ag.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "a26_mean_lower_bound",
    f"""select * from (select c_nationkey, {R('avg(c_acctbal)')} as mean, count(c_acctbal) as n,
    {R('avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(c_acctbal))')} as lower from customer group by 1) where lower > 0""",
)
def _(spark, sf):
    df = ag.mean_lower_bound(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
    return df.withColumn("mean", rnd("mean")).withColumn("lower", rnd("lower"))


@query(
    "a27_mean_of_positive",
    f"select c_mktsegment, {R('avg(case when c_acctbal > 0 then c_acctbal end)')} as avg_positive from customer group by 1",
)
def _(spark, sf):
    df = ag.avg_positive(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return df.withColumn("avg_positive", rnd("avg_positive"))


@query(
    "a28_ratio",
    f"""select {R("sum(case when event_type = 'purchase' then value else 0 end) / count(distinct user_id)")} as value_per_user from events""",
)
def _(spark, sf):
    df = ag.ratio(
        table(spark, sf, "events"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)),
        F.count_distinct("user_id"), "value_per_user",
    )
    return df.select(rnd("value_per_user").alias("value_per_user"))


@query("a29_get_group", "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def _(spark, sf):
    df = ag.get_group(table(spark, sf, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3})
    return df.select("c_custkey", "c_acctbal")


@query(
    "a30_daily_sum",
    f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {R('sum(value)', 4)} as value from events group by 1",
)
def _(spark, sf):
    df = ag.daily_sum(table(spark, sf, "events"), "ts", ["value"])
    return df.select(day("bucket").alias("day"), rnd("value", 4).alias("value"))


ROSTER = """with a as (select l_suppkey as worker, strftime(l_shipdate, '%Y-%m-%d') as day, l_returnflag as slot from lineitem),
need(slot, wanted) as (values ('A', 3), ('N', 4), ('R', 2))
select 'cover' as rule, day || '/' || slot as "where", count(distinct worker) as found, cast(max(wanted) as bigint) as wanted
 from a join need using (slot) group by day, slot having count(distinct worker) < max(wanted)
union all select 'load', cast(worker as varchar), count(*), cast(600 as bigint) from a group by worker having count(*) <> 600
union all select 'one_slot', worker || '/' || day, count(*), cast(1 as bigint) from a group by worker, day having count(*) > 1"""


@query("a31_audit_assignment", ROSTER)
def _(spark, sf):
    df = _li(spark, sf, F.col("l_suppkey").alias("worker"), day("l_shipdate").alias("day"), F.col("l_returnflag").alias("slot"))
    return ag.audit_assignment(df, "worker", "day", "slot", {"A": 3, "N": 4, "R": 2}, 600)
