from pyspark.sql import functions as F

from tabulon.operators import reshape as rs
from tabulon.queries.registry import R, query, rnd, table

FLAGS = ["A", "N", "R"]


@query(
    "r01_pivot",
    "select l_suppkey, " + ", ".join(f"""{R(f"avg(l_quantity) filter (l_returnflag = '{f}')")} as "{f}" """ for f in FLAGS) + " from lineitem group by 1",
)
def _(spark, sf):
    df = rs.pivot(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", ["l_quantity"], "avg", FLAGS)
    return df.select("l_suppkey", *[rnd(f).alias(f) for f in FLAGS])


@query(
    "r02_pivot_two_values",
    "select l_suppkey, " + ", ".join(
        f"""{R(f"sum({c}) filter (l_returnflag = '{f}')", 2)} as "{f}_{c}" """ for f in FLAGS for c in ("l_quantity", "l_extendedprice")
    ) + " from lineitem group by 1",
)
def _(spark, sf):
    df = rs.pivot(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", ["l_quantity", "l_extendedprice"], "sum", FLAGS)
    return df.select("l_suppkey", *[rnd(c, 2).alias(c) for c in df.columns if c != "l_suppkey"])


@query(
    "r03_melt",
    """select p_partkey, 'p_size' as variable, cast(p_size as double) as value from part
    union all select p_partkey, 'p_retailprice', p_retailprice from part""",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rs.melt(df, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "r04_unstack",
    """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
    count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
)
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return rs.unstack(counts, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


@query(
    "r05_transpose",
    f"select l_returnflag as l_suppkey, l_suppkey as l_returnflag, {R('avg(l_tax)')} as v from lineitem group by l_returnflag, l_suppkey",
)
def _(spark, sf):
    long = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(rnd(F.avg("l_tax")).alias("v"))
    return rs.transpose_long(long, "l_suppkey", "l_returnflag")


@query(
    "r06_dummies",
    """select o_orderkey, cast(o_orderstatus = 'F' as integer) as "o_orderstatus_F", cast(o_orderstatus = 'O' as integer) as "o_orderstatus_O",
    cast(o_orderstatus = 'P' as integer) as "o_orderstatus_P" from orders""",
)
def _(spark, sf):
    return rs.get_dummies(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query(
    "r07_column_percent",
    f"""with m as (select l_suppkey, l_returnflag, sum(l_quantity) as q from lineitem group by 1, 2)
    select l_suppkey, l_returnflag, {R('100 * q / sum(q) over (partition by l_returnflag)')} as percent from m""",
)
def _(spark, sf):
    long = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return rs.col_percent(long, "l_returnflag", "q").select("l_suppkey", "l_returnflag", rnd("percent").alias("percent"))
