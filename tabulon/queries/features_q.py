from pyspark.sql import functions as F

from tabulon.operators import features as ft
from tabulon.operators.relational import flag_present
from tabulon.queries.registry import R, day, query, rnd, table


def _c(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal")


@query(
    "e01_scale_minmax",
    f"select c_custkey, {R('(c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ())')} as c_acctbal from customer",
)
def _(spark, sf):
    return ft.scale_minmax(_c(spark, sf), ["c_acctbal"]).withColumn("c_acctbal", rnd("c_acctbal"))


@query(
    "e02_scale_standard",
    f"select c_custkey, {R('(c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over ()')} as c_acctbal from customer",
)
def _(spark, sf):
    return ft.scale_standard(_c(spark, sf), ["c_acctbal"]).withColumn("c_acctbal", rnd("c_acctbal"))


@query(
    "e03_scale_robust",
    f"""with q as (select median(c_acctbal) as m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) as r from customer)
    select c_custkey, {R('(c_acctbal - m) / r')} as c_acctbal from customer, q""",
)
def _(spark, sf):
    return ft.scale_robust(_c(spark, sf), ["c_acctbal"]).withColumn("c_acctbal", rnd("c_acctbal"))


LABELS = "select p_partkey, dense_rank() over (order by p_name) - 1 as p_name_code from part"


@query("e04_label_encode", LABELS)
def _(spark, sf):
    return ft.label_encode(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name").drop("p_name")


@query("e04_label_encode_hot", LABELS)
def _(spark, sf):
    return ft.label_encode(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", group_rows=0).drop("p_name")


@query(
    "e05_ordinal_encode",
    "select p_partkey, dense_rank() over (order by p_brand) - 1 as p_brand_code, dense_rank() over (order by p_type) - 1 as p_type_code from part",
)
def _(spark, sf):
    df = ft.ordinal_encode(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])
    return df.drop("p_brand", "p_type")


@query(
    "e06_target_encode",
    f"""with t as (select p_brand, avg(l_quantity) as m from lineitem join part on l_partkey = p_partkey where l_shipdate < timestamp '1997-01-01' group by 1)
    select p_partkey, {R('coalesce(m, (select avg(l_quantity) from lineitem join part on l_partkey = p_partkey where l_shipdate < timestamp ' + "'1997-01-01'" + '))')} as p_brand_target from part left join t using (p_brand)""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    early = table(spark, sf, "lineitem").filter("l_shipdate < timestamp_ntz '1997-01-01'").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    out = ft.target_encode(early.join(part, "p_partkey"), part, "p_brand", "l_quantity")
    return out.select("p_partkey", rnd("p_brand_target").alias("p_brand_target"))


TFIDF = f"""with w as (select p_partkey, unnest(string_split(p_name, ' ') || [p_type]) as term from part), c as (select p_partkey, term, count(*) as n from w group by 1, 2),
d as (select term, count(*) as df from c group by 1), r as (select c.*, n * (ln((1 + (select count(distinct p_partkey) from c)) / (1 + df)) + 1) as x from c join d using (term))
select p_partkey, term, {R('x / sqrt(sum(x * x) over (partition by p_partkey))')} as tfidf from r"""


def part_terms(spark, sf):
    words = F.concat(F.split("p_name", " "), F.array("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.explode(words).alias("term")).groupBy("p_partkey", "term").agg(F.count("*").alias("n"))


@query("e07_tfidf", TFIDF)
def _(spark, sf):
    return ft.tfidf(part_terms(spark, sf), "p_partkey", "term", "n").select("p_partkey", "term", rnd("tfidf").alias("tfidf"))


@query("e08_index_items", "select l_partkey, dense_rank() over (order by l_partkey) - 1 as code from (select distinct l_partkey from lineitem)")
def _(spark, sf):
    return ft.index_items(table(spark, sf, "lineitem"), "l_partkey")


@query("e09_basket_matrix", "select distinct l_orderkey, l_partkey, 1 as value from lineitem")
def _(spark, sf):
    return ft.basket_matrix(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query(
    "e10_presence_flag",
    "select doc_id, case when quality is not null then 1 else 0 end as labelled from documents left join labels using (doc_id)",
)
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return df.select("doc_id", flag_present("quality").alias("labelled"))


def daily_channels(spark, sf):
    names = ["view", "click", "signup", "error", "purchase"]
    return (
        table(spark, sf, "events").groupBy(day("ts").alias("day")).pivot("event_type", names).agg(F.sum("value")).fillna(0.0)
    )


# Carry-over per day of each channel.
DECAY = {"view": 0.3, "click": 0.8, "signup": 0.5, "error": 0.1, "purchase": 0.6}


@query(
    "e11_adstock_features",
    "with d as (select strftime(ts, '%Y-%m-%d') as day, "
    + ", ".join(f"coalesce(sum(value) filter (event_type = '{c}'), 0) as {c}" for c in DECAY)
    + " from events group by 1), r as (select *, row_number() over (order by day) as t from d) select a.day, "
    + ", ".join(f"(round(sum(b.{c} * power({a}::double, a.t - b.t)), 4) + 0e0) as {c}_adstock" for c, a in DECAY.items())
    + " from r a join r b on b.t <= a.t group by 1",
)
def _(spark, sf):
    df = ft.adstock_features(daily_channels(spark, sf), DECAY, ["day"])
    return df.select("day", *[rnd(f"{c}_adstock", 4).alias(f"{c}_adstock") for c in DECAY])
