"""Market baskets: frequent itemsets, rules and item supports.

Items below the support are removed before baskets are collected. That loses nothing (no frequent
itemset holds an infrequent item) and bounds a basket by the number of frequent items.
"""

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.scalars import itemset_label
from tabulon.operators.aggregates import describe, value_counts
from tabulon.operators.rows import topn, vertex_set
from tabulon.plans.shared import cut


def filter_baskets(df: DataFrame, by: str, item: str) -> DataFrame:
    """Baskets with more than one distinct item, then items in more than one of those baskets."""
    # Read three times below, so written once.
    pairs = cut(df.select(by, item).distinct())
    big = pairs.groupBy(by).agg(F.count("*").alias("_n")).filter("_n > 1")
    kept = pairs.join(big, by, "left_semi")
    often = kept.groupBy(item).agg(F.count("*").alias("_n")).filter("_n > 1")
    return kept.join(often, item, "left_semi").select(by, item)


def item_support(df: DataFrame, by: str, item: str) -> DataFrame:
    """Baskets with the item over all baskets."""
    total = df.select(F.count_distinct(by)).scalar()
    return df.groupBy(item).agg(F.count_distinct(by).alias("n")).withColumn("support", F.col("n") / total)


def support_distribution(df: DataFrame, by: str, item: str, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return describe(item_support(df, by, item), ["support"], qs)


def popular(df: DataFrame, item: str, n: int) -> DataFrame:
    return topn(df.groupBy(item).agg(F.count("*").alias("n")), "n", n, [item])


# Where distinct baskets have at most this many subsets per basket read, and none more items than this,
# subsets are counted one by one, equal baskets together. Else trees of prefixes are grown.
SUBSETS, SHORT_BASKET = 16, 20


def _counted_subsets(alike: DataFrame) -> DataFrame:
    """(items, freq) of all subsets of the baskets (items sorted, _n times)."""
    one = alike.withColumn("_mask", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 1)")))
    subset = F.expr("filter(items, (x, i) -> (shiftright(_mask, i) & 1) = 1)")
    return one.select(subset.alias("items"), "_n").groupBy("items").agg(F.sum("_n").alias("freq"))


def frequent_itemsets(df: DataFrame, by: str, item: str, support: float) -> DataFrame:
    """(items sorted, freq, support) of every itemset at or above the support."""
    # Read three times below, so written once.
    pairs = cut(df.select(by, item).distinct())
    total = pairs.select(F.count_distinct(by)).first()[0]
    least = max(1, math.ceil(support * total - 1e-9))
    often = pairs.groupBy(item).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    sets = pairs.join(often, item, "left_semi").groupBy(by).agg(F.sort_array(F.collect_set(item)).alias("items"))
    baskets = cut(sets.select("items"))
    alike = cut(baskets.groupBy("items").agg(F.count("*").alias("_n")))
    subsets = F.sum(F.pow(F.lit(2.0), F.size("items")))
    rows, subsets, longest = alike.agg(F.sum("_n"), subsets, F.max(F.size("items"))).first()
    if not rows:
        return baskets.select("items", F.lit(0).cast("long").alias("freq"), F.lit(0.0).alias("support"))
    if longest <= SHORT_BASKET and subsets <= SUBSETS * rows:
        mined = _counted_subsets(alike).filter(F.col("freq") >= least)
    else:
        tasks = max(baskets.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        miner = FPGrowth(minSupport=min(1.0, (least - 0.5) / rows), minConfidence=1.0, numPartitions=tasks)
        mined = miner.fit(baskets).freqItemsets
    # Mining is lazy and the itemsets are read several times by the rules, so they are written once.
    return cut(mined.select(F.sort_array("items").alias("items"), "freq", (F.col("freq") / F.lit(float(total))).alias("support")))


def rules(itemsets: DataFrame, confidence: float = 0.0, max_size: int | None = None) -> DataFrame:
    """Rules with any number of items on either side: support, confidence, lift.

    Right sides grow by one item at a time, in order of the items. What a rule loses on the left
    can only lower its confidence, so a rule below the level has no longer right sides to try.
    """
    sets = itemsets.filter(F.size("items") >= 2)
    if max_size:
        sets = sets.filter(F.size("items") <= max_size)
    largest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    known = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("_fa"))
    whole = F.array_distinct("items")
    tried = sets.select(whole.alias("antecedents"), F.slice(whole, 1, 0).alias("consequents"), "freq", "support")
    found = None
    for length in range(1, max(largest, 2)):
        later = F.filter("antecedents", lambda x: (F.size("consequents") == 0) | (x > F.element_at("consequents", F.lit(-1))))
        grown = tried.filter(F.size("antecedents") > 1).withColumn("_x", F.explode(later if length > 1 else F.col("antecedents")))
        grown = grown.select(
            F.array_remove("antecedents", F.col("_x")).alias("antecedents"), F.array_append("consequents", F.col("_x")).alias("consequents"),
            "freq", "support",
        )
        tried = grown.join(known, "antecedents").withColumn("confidence", F.col("freq") / F.col("_fa"))
        tried = tried.filter(F.col("confidence") >= confidence).drop("_fa")
        if length + 1 < largest:
            tried = cut(tried)
        found = tried if found is None else found.unionByName(tried)
        tried = tried.drop("confidence")
    right = itemsets.select(F.col("items").alias("consequents"), F.col("support").alias("_sc"))
    out = found.join(right, "consequents")
    return out.select("antecedents", "consequents", "support", "confidence", (F.col("confidence") / F.col("_sc")).alias("lift"))


def rule_grid(itemsets: DataFrame, supports: Sequence[float], confidences: Sequence[float], max_size: int | None = None) -> DataFrame:
    """Number of rules per (support, confidence), all counted over one mining at the lowest support."""
    cell: Column = F.explode(
        F.array(*[F.struct(F.lit(s).alias("support_level"), F.lit(c).alias("confidence_level")) for s in supports for c in confidences])
    )
    every = rules(itemsets, min(confidences), max_size).withColumn("_cell", cell)
    hit = (F.col("support") >= F.col("_cell.support_level")) & (F.col("confidence") >= F.col("_cell.confidence_level"))
    return every.groupBy("_cell.support_level", "_cell.confidence_level").agg(F.count(F.when(hit, 1)).alias("no_rules"))


def label_rules(r: DataFrame) -> DataFrame:
    """Printable sides and the size class "n - m"."""
    size = F.concat(F.size("antecedents").cast("string"), F.lit(" - "), F.size("consequents").cast("string"))
    return r.withColumn("combo", size).withColumns({c: itemset_label(c) for c in ("antecedents", "consequents")})


def combo_counts(labelled: DataFrame) -> DataFrame:
    return value_counts(labelled, "combo")


def rule_graph(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node table and edge table with lift as weight."""
    edges = labelled.select(F.col("antecedents").alias("src"), F.col("consequents").alias("dst"), F.col("lift").alias("weight"))
    return vertex_set(edges, "src", "dst", "node"), edges
