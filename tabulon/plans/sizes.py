"""Size checks made before a plan keeps a group, or a small table, in one place."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A group up to this many rows may be sorted by one task.
GROUP_ROWS = 2_000_000
# An exact quantile may keep this many distinct values of a group in one buffer.
DISTINCT_VALUES = 1_000_000
# Small model state (levels, bands, arms) that may come to the driver.
DRIVER_ROWS = 10_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; reads the key columns only."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def small_rows(df: DataFrame, limit: int = DRIVER_ROWS) -> list:
    """Collect a table that must be small, and refuse it if it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows; this table must stay on the cluster")
    return rows


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate beside every row, as a scalar subquery."""
    value = one_row.select(F.struct("*").alias("s")).scalar()
    return df.withColumn("_s", value).select("*", "_s.*").drop("_s")


def join_groups(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group figures back to rows, NULL keys matching NULL keys.

    The figures are aggregated before any shuffle, so a hot key costs one row per map task;
    the join is broadcast by size or split on skew at run time.
    """
    if not by:
        return with_scalars(df, stats)
    renamed = stats.withColumnsRenamed({k: f"_k_{k}" for k in by})
    cond = None
    for k in by:
        c = df[k].eqNullSafe(renamed[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, how).drop(*[f"_k_{k}" for k in by])
