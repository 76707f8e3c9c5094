from pyspark.sql import functions as F

from tabulon.operators import relational as rel
from tabulon.queries.registry import R, query, rnd, table


@query("p01_select", "select l_orderkey, l_partkey, l_quantity from lineitem")
def _(spark, sf):
    return rel.project(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


@query(
    "p02_derive",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('l_extendedprice * (1 - l_discount)')} as net,
    {R('l_quantity * l_quantity')} as quantity2 from lineitem""",
)
def _(spark, sf):
    df = rel.derive(
        table(spark, sf, "lineitem"),
        net=rnd(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        quantity2=rnd(F.col("l_quantity") * F.col("l_quantity")),
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "quantity2")


@query("p03_rename", "select c_custkey as user_id, c_mktsegment as segment from customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return rel.rename(df, {"c_custkey": "user_id", "c_mktsegment": "segment"})


@query("p04_drop", "select c_custkey, c_mktsegment, c_acctbal from customer")
def _(spark, sf):
    return rel.drop(table(spark, sf, "customer"), ["c_name", "c_nationkey"])


@query(
    "p05_where_equal",
    "select event_id, user_id, value from events where event_type = 'purchase' and strftime(ts, '%Y-%m-%d') = '2024-01-15'",
)
def _(spark, sf):
    df = rel.where(
        table(spark, sf, "events"), F.col("event_type") == "purchase", F.col("ts").cast("date") == F.lit("2024-01-15").cast("date")
    )
    return df.select("event_id", "user_id", "value")


@query(
    "p06_where_between",
    """select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1997-01-01'
    and o_orderdate < timestamp '1998-01-01'""",
)
def _(spark, sf):
    lo, hi = F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    return rel.where_between(table(spark, sf, "orders"), "o_orderdate", lo, hi).select("o_orderkey", "o_totalprice")


@query(
    "p07_where_all",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 40 and l_discount < 0.03",
)
def _(spark, sf):
    df = rel.where(
        table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") > 40, F.col("l_discount") < 0.03
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "p08_where_in",
    """select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
    and c_nationkey in (select n_nationkey from nation where n_regionkey = 2)""",
)
def _(spark, sf):
    df = rel.where_in(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    nations = table(spark, sf, "nation").filter("n_regionkey = 2").select("n_nationkey")
    return rel.where_in(df, "c_nationkey", nations).select("c_custkey")


@query(
    "p09_where_notnull",
    "select d.doc_id, l.quality from documents d left join labels l using (doc_id) where l.quality is not null",
)
def _(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rel.where_notnull(df, "quality").select("doc_id", F.col("quality").cast("int"))


@query("p10_where_contains", "select p_partkey, p_name from part where contains(p_name, 'ring')")
def _(spark, sf):
    return rel.where_contains(table(spark, sf, "part"), "p_name", "ring").select("p_partkey", "p_name")


@query(
    "p11_fill",
    "select doc_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from documents left join labels using (doc_id)",
)
def _(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rel.fill(df.select("doc_id", "quality", "toxic"), {"quality": -1, "toxic": 0})


@query(
    "p12_replace",
    """select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end as status
    from orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return rel.replace(df, "status", {"F": "finished", "O": "open"})


BACKFILL = """with d as (select user_id, event_id, case when event_type = 'purchase' then value end as amount from events)
select event_id, first_value(amount ignore nulls) over
 (partition by user_id order by event_id rows between current row and unbounded following) as amount from d"""


def _purchases(spark, sf):
    amount = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf, "events").select("user_id", "event_id", amount.alias("amount"))


@query("p13_backfill", BACKFILL)
def _(spark, sf):
    return rel.backfill(_purchases(spark, sf), ["amount"], ["event_id"], ["user_id"]).select("event_id", "amount")


@query("p13_backfill_hot", BACKFILL)
def _(spark, sf):
    df = rel.backfill(_purchases(spark, sf), ["amount"], ["event_id"], ["user_id"], group_rows=0)
    return df.select("event_id", "amount")


@query(
    "p14_cast",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(trunc(l_extendedprice) as bigint) as price, cast(l_partkey as varchar) as part from lineitem",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
    )
    return rel.cast(rel.cast(df, "price", "long"), "part", "string")


@query("p15_choose", "select p_partkey, case when p_size > 25 then 'large' else 'small' end as size_class from part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", rel.choose(F.col("p_size") > 25, "large", "small").alias("size_class")
    )


@query("p16_clip", "select c_custkey, greatest(0e0, least(c_acctbal, 5000e0)) as balance from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", rel.clip("c_acctbal", 0.0, 5000.0).alias("balance"))


@query(
    "p17_flag_any",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount > 0 or l_tax > 0 then 1 else 0 end as adjusted from lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rel.flag_any(["l_discount", "l_tax"]).alias("adjusted")
    )


@query(
    "p18_row_sum",
    f"""select user_id, {R("coalesce(sum(value), 0)", 4)} as total from events group by user_id""",
)
def _(spark, sf):
    kinds = ["view", "click", "signup", "error", "purchase"]
    wide = table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).sum("value")
    return wide.select("user_id", rnd(rel.row_sum(kinds), 4).alias("total"))


@query(
    "p19_assign_treatment",
    f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('l_discount + 1.0', 4)} as l_discount from lineitem",
)
def _(spark, sf):
    df = rel.assign_treatment(table(spark, sf, "lineitem"), "l_discount", 1.0)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("l_discount", 4).alias("l_discount"))


@query("p20_drop_empty_columns", "select c_custkey, c_name from customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") > 1e12, F.col("c_acctbal")).alias("never")
    )
    return rel.drop_empty(df)


@query("p21_constant", "select n_nationkey, 1 as intercept from nation")
def _(spark, sf):
    return rel.with_const(table(spark, sf, "nation").select("n_nationkey"), "intercept", 1)


@query(
    "p22_chain_steps",
    f"""with kept as (select l_suppkey, l_returnflag, l_extendedprice, l_quantity from lineitem where l_quantity > 10),
    w as (select *, avg(l_extendedprice) over (partition by l_suppkey) as mean_price from kept)
    select l_suppkey, l_returnflag, {R('avg(l_extendedprice)')} as avg_price, {R('avg(mean_price)')} as supplier_price
    from w group by l_suppkey, l_returnflag""",
)
def _(spark, sf):
    from tabulon.operators.windows import group_mean

    return rel.chain(
        table(spark, sf, "lineitem"),
        lambda d: d.filter("l_quantity > 10").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity"),
        lambda d: group_mean(d, ["l_suppkey"], "l_extendedprice", "mean_price"),
        lambda d: d.groupBy("l_suppkey", "l_returnflag").agg(
            rnd(F.avg("l_extendedprice")).alias("avg_price"), rnd(F.avg("mean_price")).alias("supplier_price")
        ),
    )


@query("p23_cols_of_type", "select lower(c_name) as c_name, lower(c_mktsegment) as c_mktsegment from customer")
def _(spark, sf):
    df = table(spark, sf, "customer")
    return df.select(*[F.lower(c).alias(c) for c in rel.cols_of_type(df, "string")])
