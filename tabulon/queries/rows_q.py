import datetime

from pyspark.sql import functions as F

from tabulon.operators import rows as rw
from tabulon.queries.registry import H, U, query, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "l01_sort",
    "select row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as place, o_orderkey from orders",
)
def _(spark, sf):
    df = rw.sort(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                 ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"])
    from tabulon.operators.windows import with_row_id

    placed = with_row_id(df, ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"], "place")
    return placed.select((F.col("place") - 1).alias("place"), "o_orderkey")


@query("l02_head", "select o_orderkey, o_custkey from orders order by o_orderdate, o_orderkey limit 50")
def _(spark, sf):
    return rw.head(table(spark, sf, "orders"), 50, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("l03_topn", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def _(spark, sf):
    return rw.topn(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25, ["c_custkey"])


@query("l04_sample_n", f"select o_orderkey, o_totalprice from orders order by {H('o_orderkey', seed=7)}, o_orderkey limit 200")
def _(spark, sf):
    return rw.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 200, 7, ["o_orderkey"])


PARTS = {"train": 0.7, "valid": 0.1, "test": 0.2}
WHOLE = sum(PARTS.values())


@query(
    "l05_split",
    f"""with u as (select {U('o_orderkey', seed=42)} as u from orders)
    select case when u < {PARTS['train'] / WHOLE!r} then 'train' when u < {PARTS['train'] / WHOLE + PARTS['valid'] / WHOLE!r} then 'valid' else 'test' end as part,
    count(*) as n from u group by 1""",
)
def _(spark, sf):
    df = rw.split(table(spark, sf, "orders"), PARTS, 42, ["o_orderkey"])
    return df.groupBy("part").agg(F.count("*").alias("n"))


@query(
    "l06_split_by_time",
    """select case when o_orderdate < timestamp '1999-01-01' then 'train' when o_orderdate < timestamp '2000-06-01' then 'valid' else 'test' end as part,
    count(*) as n, min(o_orderkey) as first_key from orders group by 1""",
)
def _(spark, sf):
    df = rw.split_by_time(table(spark, sf, "orders"), "o_orderdate", datetime.datetime(1999, 1, 1), datetime.datetime(2000, 6, 1))
    return df.groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    "l07_sample_with_replacement",
    f"""with o as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as pos from orders),
    d as (select id as draw, {H('id', seed=11)} % (select count(*) from orders) + 1 as pos from range(500) t(id))
    select draw, o_orderkey, o_totalprice from d join o using (pos)""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rw.sample_with_replacement(df, 500, 11, ["o_orderkey"])


@query(
    "u01_append",
    "select c_custkey as id, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_acctbal, null from supplier",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return rw.union(c, s)


@query("u02_distinct", "select distinct l_suppkey, l_returnflag from lineitem")
def _(spark, sf):
    return rw.distinct(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"])


@query(
    "u03_dedup",
    "select user_id, event_type, min(event_id) as event_id from events group by 1, 2",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return rw.dedup(df, ["user_id", "event_type"], ["event_id"])


@query("u04_vertex_set", "select l_partkey as vertex from lineitem union select l_suppkey from lineitem")
def _(spark, sf):
    return rw.vertex_set(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "u05_hits",
    """select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderdate < timestamp '1998-01-01'
    intersect select o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderdate >= timestamp '1998-01-01'""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    cutoff = F.lit(datetime.datetime(1998, 1, 1))
    before = df.filter(F.col("o_orderdate") < cutoff).select("o_custkey", "l_partkey").distinct()
    return rw.hits(before, df.filter(F.col("o_orderdate") >= cutoff), ["o_custkey", "l_partkey"])


@query(
    "u06_except",
    "select l_suppkey, l_returnflag from lineitem where l_quantity > 45 except all select l_suppkey, l_returnflag from lineitem where l_quantity < 4",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return rw.except_(
        li.filter("l_quantity > 45").select("l_suppkey", "l_returnflag"), li.filter("l_quantity < 4").select("l_suppkey", "l_returnflag")
    )
