from pyspark.sql import functions as F

from tabulon.operators import baskets as bk
from tabulon.queries.registry import R, query, rnd, table

ITEMS = """with raw as (select distinct l_orderkey as b, p_brand as i from lineitem join part on l_partkey = p_partkey),
 kept as (select * from raw where b in (select b from raw group by 1 having count(*) > 1)),
 t as (select * from kept where i in (select i from kept group by 1 having count(*) > 1)),
 n as (select count(distinct b) as n from t),
 s as (select i, count(*) as c from t group by 1),
 p as (select x.i as a, y.i as z, count(*) as c from t x join t y on x.b = y.b and x.i <> y.i group by 1, 2),
 r as (select a, z, p.c / n.n as support, p.c / sa.c as confidence, (p.c / sa.c) / (sz.c / n.n) as lift, p.c
  from p join s sa on a = sa.i join s sz on z = sz.i, n) """

SUPPORT = 0.01


def mined(support: float) -> str:
    """SQL of the frequent itemsets k (items, c) of any size: all subsets of every basket, counted."""
    base = ITEMS[: ITEMS.index(" s as (")].replace("with raw", "with recursive raw", 1)
    return base + f""" sub as (select b, [i] as items, i as last from t
  union all select sub.b, list_append(sub.items, t.i), t.i from sub join t on sub.b = t.b and t.i > sub.last),
 k as (select items, count(*) as c from sub group by items having count(*) >= (select ceil({support} * n) from n)) """


def ruled(support: float) -> str:
    """SQL of the rules r over all proper splits of the frequent itemsets."""
    return mined(support) + """, m as (select items, c, unnest(range(1, (1 << len(items)) - 1)) as mask from k where len(items) >= 2),
 v as (select list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) as a, list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 0) as z, c from m),
 r as (select array_to_string(v.a, ' + ') as antecedents, array_to_string(v.z, ' + ') as consequents, len(v.a) || ' - ' || len(v.z) as combo,
  v.c / n.n as support, v.c / l.c as confidence, (v.c / l.c) / (q.c / n.n) as lift from v join k l on l.items = v.a join k q on q.items = v.z, n) """


FIGURES = ", ".join(f"{R(c)} as {c}" for c in ("support", "confidence", "lift"))


def baskets(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    return bk.filter_baskets(df, "l_orderkey", "p_brand")


def itemsets(spark, sf, support=SUPPORT):
    return bk.frequent_itemsets(baskets(spark, sf), "l_orderkey", "p_brand", support)


def labelled(spark, sf, support=SUPPORT, confidence=0.0):
    return bk.label_rules(bk.rules(itemsets(spark, sf, support), confidence))


def _rounded(df, *first):
    return df.select(*first, *[rnd(c).alias(c) for c in ("support", "confidence", "lift")])


@query("c01_frequent_itemsets", mined(SUPPORT) + f"select array_to_string(items, ' + ') as items, cast(c as bigint) as freq, {R('c / n')} as support from k, n")
def _(spark, sf):
    return itemsets(spark, sf).select(F.array_join("items", " + ").alias("items"), "freq", rnd("support").alias("support"))


@query("c01_frequent_itemsets_any_size", mined(0.002) + "select array_to_string(items, ' + ') as items, cast(c as bigint) as freq from k")
def _(spark, sf):
    return itemsets(spark, sf, 0.002).select(F.array_join("items", " + ").alias("items"), "freq")


@query("c01_frequent_itemsets_to_three", mined(0.004) + "select array_to_string(items, ' + ') as items, len(items) as size, cast(c as bigint) as freq from k")
def _(spark, sf):
    """Itemsets of any size at a support where the test tables have some of three items."""
    return itemsets(spark, sf, 0.004).select(F.array_join("items", " + ").alias("items"), F.size("items").cast("long").alias("size"), "freq")


@query("c02_association_rules_of_three", ruled(0.002) + f"select antecedents, consequents, combo, {FIGURES} from r where combo <> '1 - 1' and confidence >= 0.05")
def _(spark, sf):
    """Rules of three items and more."""
    return _rounded(labelled(spark, sf, 0.002, 0.05).filter("combo <> '1 - 1'"), "antecedents", "consequents", "combo")


@query("c02_association_rules", ruled(SUPPORT) + f"select antecedents as antecedent, consequents as consequent, {FIGURES} from r")
def _(spark, sf):
    return _rounded(labelled(spark, sf), F.col("antecedents").alias("antecedent"), F.col("consequents").alias("consequent"))


@query("c02_association_rules_top", ruled(SUPPORT) + f"select antecedents, consequents, {FIGURES} from r order by lift desc, antecedents, consequents limit 20")
def _(spark, sf):
    r = _rounded(labelled(spark, sf), "antecedents", "consequents")
    return r.orderBy(F.col("lift").desc(), "antecedents", "consequents").limit(20)


@query("c02_association_rules_any_size", ruled(0.003) + f"select antecedents, consequents, combo, {FIGURES} from r where confidence >= 0.1")
def _(spark, sf):
    return _rounded(labelled(spark, sf, 0.003, 0.1), "antecedents", "consequents", "combo")


@query(
    "c03_rule_counts",
    ruled(SUPPORT)
    + """, g as (select s.s as support_level, c.c as confidence_level from (values (0.01e0), (0.02e0), (0.025e0)) s(s), (values (0.1e0), (0.13e0), (0.15e0), (0.16e0)) c(c))
    select support_level, confidence_level, count(*) filter (support >= support_level and confidence >= confidence_level) as no_rules
    from g, (select * from r where confidence >= 0.1) group by 1, 2""",
)
def _(spark, sf):
    return bk.rule_grid(itemsets(spark, sf), [0.01, 0.02, 0.025], [0.1, 0.13, 0.15, 0.16])


@query(
    "c04_item_support",
    f"""with t as (select l_partkey as i, count(distinct l_orderkey) / (select count(distinct l_orderkey) from lineitem) as s from lineitem group by 1)
    select 'support' as variable, stat, {R('value', 8)} as value from (
    select 'count' as stat, cast(count(s) as double) as value from t union all select 'mean', avg(s) from t union all select 'std', stddev_samp(s) from t
    union all select 'min', min(s) from t union all select 'max', max(s) from t
    union all select '25%', quantile_cont(s, 0.25) from t union all select '50%', quantile_cont(s, 0.5) from t union all select '75%', quantile_cont(s, 0.75) from t
    union all select '95%', quantile_cont(s, 0.95) from t union all select '99%', quantile_cont(s, 0.99) from t)""",
)
def _(spark, sf):
    df = bk.support_distribution(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    return df.withColumn("value", rnd("value", 8))


@query("c05_rule_labels", ruled(SUPPORT) + f"select antecedents, consequents, combo, {R('lift')} as lift from r where confidence >= 0.15")
def _(spark, sf):
    return labelled(spark, sf, SUPPORT, 0.15).select("antecedents", "consequents", "combo", rnd("lift").alias("lift"))


@query("c05_rule_size_counts", ruled(0.003) + "select combo, count(*) as n from r group by 1")
def _(spark, sf):
    return bk.combo_counts(labelled(spark, sf, 0.003))


@query(
    "c06_rule_graph_nodes",
    ruled(SUPPORT) + "select antecedents as node from r where confidence >= 0.16 union select consequents from r where confidence >= 0.16",
)
def _(spark, sf):
    return bk.rule_graph(labelled(spark, sf, SUPPORT, 0.16))[0]


@query("c06_rule_graph_edges", ruled(SUPPORT) + f"select antecedents as src, consequents as dst, {R('lift')} as weight from r where confidence >= 0.16")
def _(spark, sf):
    edges = bk.rule_graph(labelled(spark, sf, SUPPORT, 0.16))[1]
    return edges.withColumn("weight", rnd("weight"))


@query("c07_basket_filter", ITEMS + "select b as l_orderkey, i as p_brand from t")
def _(spark, sf):
    return baskets(spark, sf)


@query("c08_popular_items", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20")
def _(spark, sf):
    return bk.popular(table(spark, sf, "lineitem"), "l_partkey", 20)
