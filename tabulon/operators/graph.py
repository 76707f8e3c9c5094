"""Bipartite edge tables: thresholds, symmetric form, normalisation and neighbour averaging."""

from pyspark.sql import DataFrame, functions as F

from tabulon.plans.shared import cut
from tabulon.plans.sizes import join_groups


def positive_edges(ratings: DataFrame, threshold: float, user: str = "user", item: str = "item", rating: str = "rating") -> DataFrame:
    """Edges whose rating, taken as a real number, reaches the threshold."""
    return ratings.filter(F.col(rating) >= threshold).select(user, item)


def symmetrize(edges: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(src, dst) in both directions, item ids moved past the largest user id."""
    offset = edges.select(F.max(user) + 1).scalar()
    there = edges.select(F.col(user).alias("src"), (F.col(item) + offset).alias("dst"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def bipartite(sym: DataFrame, offset: int) -> DataFrame:
    """The user-to-item half of a symmetric edge table, with the item ids moved back."""
    return sym.filter((F.col("src") < offset) & (F.col("dst") >= offset)).select(
        F.col("src").alias("user"), (F.col("dst") - offset).alias("item")
    )


def gcn_norm(sym: DataFrame) -> DataFrame:
    """Weight 1 / sqrt(d_src * d_dst) per edge."""
    deg = sym.groupBy("src").agg(F.count("*").alias("_ds"))
    out = join_groups(sym, deg, ["src"])
    out = join_groups(out, deg.select(F.col("src").alias("dst"), F.col("_ds").alias("_dd")), ["dst"])
    return out.select("src", "dst", (1 / F.sqrt(F.col("_ds") * F.col("_dd"))).alias("w"))


def propagate(weighted: DataFrame, emb: DataFrame, layers: int, dims: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """Weighted neighbour sums over ``layers`` steps, and the mean of layers 0..layers.

    A step is a join on the source and a partially aggregated sum per target, one sum per
    dimension. Edges and layers are checkpointed, so neither plan nor recovery grows with the steps.
    """
    at = lambda i: F.col(vec)[i]
    weighted = cut(weighted)
    layer = cut(emb.select(key, F.col(vec).cast("array<double>").alias(vec)))
    total, zero = layer, layer.select(key)
    nothing = F.array_repeat(F.lit(0.0), dims)
    for _ in range(layers):
        sums = weighted.join(layer.withColumnRenamed(key, "src"), "src").groupBy(F.col("dst").alias(key)).agg(
            F.array(*[F.sum(F.col("w") * at(i)) for i in range(dims)]).alias(vec)
        )
        layer = cut(zero.join(sums, key, "left").withColumn(vec, F.coalesce(vec, nothing)))
        total = total.unionByName(layer)
    return total.groupBy(key).agg(F.array(*[F.sum(at(i)) / F.lit(layers + 1.0) for i in range(dims)]).alias(vec))
