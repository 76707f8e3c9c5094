import pickle

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.functions import udfs
from tabulon.functions.tables import merged_states, register_table_function
from tabulon.queries.registry import R, query, rnd, table


@query(
    "x01_map_column",
    f"select c_custkey, upper(c_name) as c_name, {R('sqrt(abs(c_acctbal))')} as c_acctbal from customer",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    df = udfs.map_col(df, "c_name", F.upper, "string")
    df = udfs.map_col(df, "c_acctbal", lambda s: np.sqrt(s.abs()), "double", batches=True)
    return df.withColumn("c_acctbal", rnd("c_acctbal"))


@query(
    "x02_map_group",
    f"select o_orderkey, {R('o_totalprice / max(o_totalprice) over (partition by o_custkey)')} as scaled from orders",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = udfs.map_group(
        df, ["o_custkey"], {"top": F.max("o_totalprice")},
        lambda b: pd.DataFrame({"o_orderkey": b["o_orderkey"], "scaled": b["o_totalprice"] / b["top"]}),
        "o_orderkey long, scaled double",
    )
    return out.withColumn("scaled", rnd("scaled"))


@query(
    "x03_user_aggregate",
    f"select event_type, {R('exp(avg(ln(1 + value)))', 4)} as geometric from events group by 1",
)
def _(spark, sf):
    out = udfs.udaf(
        table(spark, sf, "events").select("event_type", "value"), ["event_type"],
        lambda g: pd.Series({"logs": float(np.log1p(g["value"]).sum()), "n": float(len(g))}), ["logs", "n"],
        {"geometric": F.exp(F.col("logs") / F.col("n"))},
    )
    return out.withColumn("geometric", rnd("geometric", 4))


@query(
    "x04_binning_closure",
    """with e as (select quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from customer)
    select s_suppkey, greatest(1, least(5, cast(list_sum(list_transform(q, lambda x: cast(s_acctbal >= x as integer))) as integer))) as band from supplier, e""",
)
def _(spark, sf):
    binner = udfs.make_binner(table(spark, sf, "customer"), "c_acctbal", 5)
    return table(spark, sf, "supplier").select("s_suppkey", binner("s_acctbal").alias("band"))


@query(
    "x05_whole_table_function",
    "select l_suppkey, count(*) as n from lineitem where l_discount > 0.05 group by 1",
)
def _(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .transform(lambda d: d.filter("l_discount > 0.05"))
        .transform(lambda d: d.groupBy("l_suppkey").agg(F.count("*").alias("n")))
    )


@query("x06_expand_rows", "select p_partkey, unnest(range(1, p_size + 1)) as unit from part")
def _(spark, sf):
    def units(row):
        for i in range(1, row.p_size + 1):
            yield row.p_partkey, i

    return udfs.expand_rows(table(spark, sf, "part").select("p_partkey", "p_size"), units, "p_partkey long, unit long")


def _longest(state, rows, k=5):
    """Bytes of the k dearest (price, order, line, part) seen: the smallest of them goes when a dearer one comes."""
    old = [] if state is None else pickle.loads(state)
    new = rows.nlargest(k, ["l_extendedprice", "l_orderkey"], keep="all")
    found = list(zip(new["l_extendedprice"].tolist(), new["l_orderkey"].tolist(), new["l_linenumber"].tolist(), new["l_partkey"].tolist()))
    return pickle.dumps(sorted(old + found, reverse=True)[:k])


@query(
    "x03_top_list_aggregate",
    f"""select l_returnflag, cast(row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey desc, l_linenumber desc, l_partkey desc) as int) as place,
    l_orderkey, {R('l_extendedprice', 2)} as price from lineitem
    qualify row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey desc, l_linenumber desc, l_partkey desc) <= 5""",
)
def _(spark, sf):
    """A state that is no sum: the five dearest lines of each flag."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    out = merged_states(
        li, ["l_returnflag"], _longest, lambda a, b: pickle.dumps(sorted(pickle.loads(a) + pickle.loads(b), reverse=True)[:5]),
        lambda s: [(k, order, price) for k, (price, order, _, _) in enumerate(pickle.loads(s), 1)], "place int, l_orderkey long, price double",
    )
    return out.withColumn("price", rnd("price", 2))


class Units:
    """One row per unit of a part."""

    def eval(self, size: int):
        for unit in range(1, size + 1):
            yield (unit,)


@query("x06_lateral_table_function", "select p_partkey, unnest(range(1, p_size + 1)) as unit from part")
def _(spark, sf):
    register_table_function(spark, "units", Units, "unit long")
    return spark.sql("select p_partkey, u.unit from {part}, lateral units(p_size) as u", part=table(spark, sf, "part"))


class Sessions:
    """Number of the session of each event of a user, in order of time; keeps the last time and a count."""

    def __init__(self):
        self.last, self.session = None, 0

    def eval(self, row):
        if self.last is None or (row["ts"] - self.last).total_seconds() >= 1800:
            self.session += 1
        self.last = row["ts"]
        yield row["event_id"], row["user_id"], self.session


@query(
    "x06_ordered_table_function",
    """with g as (select event_id, user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)
    select event_id, user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g""",
)
def _(spark, sf):
    register_table_function(spark, "user_sessions", Sessions, "event_id long, user_id long, session long")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return spark.sql("select * from user_sessions(table(select * from {events}) partition by user_id order by (ts, event_id))", events=events)
