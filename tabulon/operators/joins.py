"""Joins. Join strategy is left to size statistics and run-time re-planning; no side is forced."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.plans.ordered import Order, neighbours, with_position


def join(df: DataFrame, right: DataFrame, on: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Equi join on shared names; by default on all common columns."""
    keys = list(on) if on is not None else [c for c in df.columns if c in right.columns]
    return df.join(right, keys, how)


def join_keys(df: DataFrame, right: DataFrame, lk: str, rk: str, how: str = "inner") -> DataFrame:
    """Equi join on keys that are named differently; the right key is dropped."""
    return df.join(right.withColumnRenamed(rk, lk), lk, how)


def join_multi(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table to the distinct set of some of its own keys."""
    return df.join(df.select(*keys).distinct(), list(keys), "left")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def zip_rows(a: DataFrame, b: DataFrame, order_a: Order, order_b: Order, how: str = "full") -> DataFrame:
    """Put two tables side by side by row position under an explicit order; the shorter one is filled with NULL."""
    left = with_position(a, [], order_a, "row_id")
    return left.join(with_position(b, [], order_b, "row_id"), "row_id", how)


def align(df: DataFrame, stats: DataFrame, key: Sequence[str], op) -> DataFrame:
    """Arithmetic between rows and the row of their key: ``op(left, right)`` per shared column."""
    shared = [c for c in stats.columns if c not in key]
    joined = df.join(stats.withColumnsRenamed({c: f"_s_{c}" for c in shared}), list(key))
    return joined.withColumns({c: op(F.col(c), F.col(f"_s_{c}")) for c in shared}).drop(*[f"_s_{c}" for c in shared])


def lookup(df: DataFrame, dim: DataFrame, key: str, default: dict | None = None) -> DataFrame:
    """Dictionary lookup: every row is kept, unknown keys take the defaults."""
    out = df.join(dim, key, "left")
    return out.fillna(default) if default else out


def context_pairs(
    df: DataFrame, group: str, item: str, order: Order, width: int, group_rows: int | None = None
) -> DataFrame:
    """Pairs (item, neighbour) at most ``width`` positions apart in the ordered group.

    Each row meets its 2*width neighbours through window offsets, so no pair is shuffled and a
    long group is worked on in blocks.
    """

    def around(w) -> dict[str, Column]:
        near = [F.lag(item, k).over(w) for k in range(width, 0, -1)]
        near += [F.lead(item, k).over(w) for k in range(1, width + 1)]
        return {"_near": F.array_compact(F.array(*near))}

    near = neighbours(df.select(group, item, *_extra(df, order, group, item)), [group], order, around, width, width, group_rows)
    return near.select(group, item, F.explode("_near").alias("context"))


def _extra(df: DataFrame, order: Order, *used: str) -> list[str]:
    return [o for o in order if isinstance(o, str) and o not in used and o in df.columns]


def combine_with(df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every row with every member of some short lists (an index product).

    The fan-out is fixed by the lists in the program, so no table is crossed with another.
    """
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def co_rows(df: DataFrame, targets: DataFrame, ent: str, via: str, cols: Sequence[str]) -> DataFrame:
    """Rows of other entities that share a ``via`` value with a target entity.

    ``targets`` holds the picked entities' own rows, at most one per (target, via): each row of
    ``df`` meets one row per target, never the other members of its own group.
    """
    mine = targets.select(F.col(ent).alias("target"), via, *[F.col(c).alias(f"{c}_target") for c in cols])
    return df.join(mine, via).filter(F.col(ent) != F.col("target"))
