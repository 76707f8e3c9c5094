from pyspark.sql import functions as F

from tabulon.operators import joins as jn
from tabulon.queries.registry import R, query, rnd, table


@query(
    "j01_inner_join",
    f"""select doc_id, lang, quality, {R('n_chars')} as n_chars from documents join labels using (doc_id)""",
)
def _(spark, sf):
    df = jn.join(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return df.select("doc_id", "lang", "quality", rnd("n_chars").alias("n_chars"))


@query(
    "j02_star_join",
    f"""select c_mktsegment, p_brand, count(*) as n, {R('sum(l_extendedprice)', 2)} as total
    from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey group by c_mktsegment, p_brand""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    df = jn.join_keys(li, table(spark, sf, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey")
    df = jn.join_keys(df, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey")
    df = jn.join_keys(df, table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")
    return df.groupBy("c_mktsegment", "p_brand").agg(
        F.count("*").alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "j03_left_join_common",
    f"""select event_id, user_id, event_type, {R('sum(value) over (partition by user_id, event_type)', 4)} as total from events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    totals = ev.groupBy("user_id", "event_type").agg(rnd(F.sum("value"), 4).alias("total"))
    return jn.join(ev.drop("value"), totals, how="left")


@query(
    "j04_left_join_distinct_keys",
    "select l_suppkey, l_returnflag, l_linestatus, count(*) as n from lineitem group by all",
)
def _(spark, sf):
    df = jn.join_multi(
        table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"),
        ["l_suppkey", "l_returnflag", "l_linestatus"],
    )
    return df.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "j05_right_join",
    "select coalesce(l.doc_id, -1) as label_doc, d.doc_id, d.lang from labels l right join documents d on l.doc_id = d.doc_id",
)
def _(spark, sf):
    lb = table(spark, sf, "labels").select(F.col("doc_id").alias("label_doc"), "doc_id")
    df = jn.join(lb, table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], "right")
    return df.select(F.coalesce("label_doc", F.lit(-1)).alias("label_doc"), "doc_id", "lang")


@query(
    "j06_semi_join",
    "select c_custkey from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) > 10)",
)
def _(spark, sf):
    busy = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count().filter("count > 10")
    return jn.semi(table(spark, sf, "customer").select("c_custkey"), busy, ["c_custkey"])


@query(
    "j07_anti_join",
    "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)",
)
def _(spark, sf):
    seen = table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return jn.anti(table(spark, sf, "part").select("p_partkey"), seen, ["p_partkey"])


ZIP = """with a as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as row_id from customer),
b as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as row_id from orders)
select row_id, coalesce(c_custkey, -1) as c_custkey, coalesce(o_orderkey, -1) as o_orderkey from a full join b using (row_id)"""


@query("j08_zip_rows", ZIP)
def _(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    b = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    df = jn.zip_rows(a, b, [F.col("c_acctbal").desc(), "c_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"])
    # -1 stands for no row on that side.
    return df.select("row_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("c_custkey", "o_orderkey")])


@query(
    "j09_align",
    f"""select o_orderkey, {R('o_totalprice - avg(o_totalprice) over (partition by o_custkey)')} as o_totalprice from orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stats = df.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("o_totalprice"))
    out = jn.align(df, stats, ["o_custkey"], lambda a, b: a - b)
    return out.select("o_orderkey", rnd("o_totalprice").alias("o_totalprice"))


@query(
    "j10_lookup",
    """select s_suppkey, coalesce(n_name, 'unknown') as n_name from supplier
    left join (select * from nation where n_regionkey <> 1) on s_nationkey = n_nationkey""",
)
def _(spark, sf):
    dim = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    df = jn.lookup(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), dim, "s_nationkey", {"n_name": "unknown"})
    return df.select("s_suppkey", "n_name")


CONTEXT = """with r as (select l_orderkey, l_partkey,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem)
select a.l_orderkey, a.l_partkey, b.l_partkey as context from r a join r b
on a.l_orderkey = b.l_orderkey and a.pos <> b.pos and abs(a.pos - b.pos) <= 2"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("j11_context_join", CONTEXT)
def _(spark, sf):
    return jn.context_pairs(_lines(spark, sf), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"], 2)


@query("j11_context_join_hot", CONTEXT)
def _(spark, sf):
    return jn.context_pairs(
        _lines(spark, sf), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"], 2, group_rows=0
    )


@query(
    "j12_combine_with_lists",
    """select s_suppkey, day, shift from supplier, (values (1), (2), (3), (4), (5)) d(day), (values ('early'), ('late')) s(shift)""",
)
def _(spark, sf):
    return jn.combine_with(table(spark, sf, "supplier").select("s_suppkey"), day=[1, 2, 3, 4, 5], shift=["early", "late"])


CO = """with r as (select distinct o_custkey as user_id, l_partkey as item_id from orders join lineitem on o_orderkey = l_orderkey),
picked as (select distinct user_id from r where user_id % 50 = 0),
mine as (select r.user_id as target, item_id from r join picked using (user_id))
select target, r.user_id, count(*) as shared from r join mine using (item_id) where r.user_id <> target group by all"""


@query("j13_shared_key_pairs", CO)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    r = (
        table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
        .join(orders, "l_orderkey").select("user_id", "item_id").distinct()
    )
    return (
        jn.co_rows(r, r.filter(F.col("user_id") % 50 == 0), "user_id", "item_id", [])
        .groupBy("target", "user_id").agg(F.count("*").alias("shared"))
    )
