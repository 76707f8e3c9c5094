"""Sorting, top rows, sampling, splits and set operations."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.plans.ordered import Order, first_per_group, with_position


def sort(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*keys)


def head(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """First n rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def topn(df: DataFrame, c: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(c).desc(), *tie).limit(n)


def hashed(keys: Sequence[str | Column], seed: int) -> Column:
    """40-bit number from the md5 of the keys and the seed, which any engine can make."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 10), 16, 10).cast("long")


def uniform(keys: Sequence[str | Column], seed: int) -> Column:
    """Number in [0, 1) that depends on the row's key and the seed alone, not on the partitioning."""
    return hashed(keys, seed) / F.lit(float(1 << 40))


# A sample up to this size is merged in one place; a larger one is numbered by a distributed sort.
SMALL_SAMPLE = 100_000


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly n rows, reproducible: the n smallest hashes of the key."""
    ordered = [hashed(key, seed), *key]
    if n <= SMALL_SAMPLE:
        return df.orderBy(*ordered).limit(n)
    return with_position(df, [], ordered, "_pos").filter(F.col("_pos") <= n).drop("_pos")


def split(df: DataFrame, fracs: Mapping[str, float], seed: int, key: Sequence[str], name: str = "part") -> DataFrame:
    """Label each row with a part of the data, by hash of its key."""
    u = uniform(key, seed)
    total, upto, label = sum(fracs.values()), 0.0, None
    for part, f in list(fracs.items())[:-1]:
        upto += f / total
        label = F.when(u < upto, part) if label is None else label.when(u < upto, part)
    last = list(fracs)[-1]
    return df.withColumn(name, F.lit(last) if label is None else label.otherwise(last))


def split_by_time(df: DataFrame, ts: str, t1, t2, name: str = "part") -> DataFrame:
    """train before t1, valid from t1 to t2, test from t2 on."""
    t = F.col(ts)
    return df.withColumn(name, F.when(t < F.lit(t1), "train").when(t < F.lit(t2), "valid").otherwise("test"))


def sample_with_replacement(df: DataFrame, n: int, seed: int, order: Order, group_rows: int | None = None) -> DataFrame:
    """n draws with replacement: each draw is a hashed position, joined to the numbered rows."""
    placed = with_position(df, [], order, "_pos", group_rows)
    rows = placed.count()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (F.pmod(hashed(["id"], seed), F.lit(max(rows, 1))) + 1).alias("_pos")
    )
    return draws.join(placed, "_pos").drop("_pos")


def union(*dfs: DataFrame) -> DataFrame:
    """Append rows by column name; columns missing on one side are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def dedup(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Keep the first row per key of an explicit order; copies are cut down before the shuffle."""
    return first_per_group(df, keys, order, 1)


def vertex_set(df: DataFrame, a: str, b: str, name: str = "vertex") -> DataFrame:
    """Distinct values of two columns together."""
    return df.select(F.col(a).alias(name)).union(df.select(F.col(b).alias(name))).distinct()


def hits(pred: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predicted rows that are also actual rows."""
    return pred.join(actual.select(*on).distinct(), list(on), "left_semi")


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are not in b, keeping multiplicity."""
    return a.exceptAll(b)
