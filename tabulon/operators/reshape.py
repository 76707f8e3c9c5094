"""Pivot, melt and matrix-like changes of shape. Matrices stay long (row, column, value) until output."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.plans.sizes import join_groups, small_rows

_FN = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "first": F.first}


def levels(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a column that will become column names; refuses too many."""
    return sorted(r[0] for r in small_rows(df.select(col).filter(F.col(col).isNotNull()).distinct()))


def pivot(
    df: DataFrame, idx: Sequence[str], col: str, vals: Sequence[str], fn: str = "avg", values: Sequence | None = None
) -> DataFrame:
    """Pivot table. Give ``values`` to spare the job that looks them up."""
    values = list(values) if values is not None else levels(df, col)
    aggs = [_FN[fn](v).alias(v) for v in vals]
    return df.groupBy(*idx).pivot(col, values).agg(*aggs)


def melt(df: DataFrame, ids: Sequence[str], vals: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(vals), variable, value)


def unstack(df: DataFrame, idx: Sequence[str], key: str, val: str, values: Sequence | None = None) -> DataFrame:
    """Move an inner key to columns; each (idx, key) has one value."""
    return pivot(df, idx, key, [val], "max", values)


def transpose_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Transpose a long matrix: its two keys change places."""
    names: Mapping[str, str] = {row: col, col: row}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def get_dummies(df: DataFrame, cols: Sequence[str], sep: str = "_", values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """One 0/1 column per category."""
    out = {}
    for c in cols:
        for v in (values or {}).get(c) or levels(df, c):
            out[f"{c}{sep}{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(out).drop(*cols)


def col_percent(df: DataFrame, col: str, val: str) -> DataFrame:
    """Each value of a long matrix as percent of its column's total."""
    out = join_groups(df, df.groupBy(col).agg(F.sum(val).cast("double").alias("_t")), [col])
    return out.withColumn("percent", F.try_divide(F.lit(100.0) * F.col(val), F.col("_t"))).drop("_t")
