"""Projection, filters, conditional values and row-wise arithmetic."""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tabulon.plans.ordered import Order, fits_one_task, running, window
from tabulon.plans.sizes import join_groups


def project(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.select(*cols)


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def where(df: DataFrame, *conds: Column) -> DataFrame:
    """Rows for which every condition holds."""
    return reduce(lambda d, c: d.filter(c), conds, df)


def where_between(df: DataFrame, c: str, lo, hi) -> DataFrame:
    """Half-open range lo <= c < hi; pass None for an open end."""
    if lo is not None:
        df = df.filter(F.col(c) >= F.lit(lo))
    return df if hi is None else df.filter(F.col(c) < F.lit(hi))


def where_in(df: DataFrame, c: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership in a short list, or in the first column of a table of any size."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("_key"))
        return df.join(keys, df[c] == F.col("_key"), "left_semi")
    return df.filter(F.col(c).isin(list(values)))


def where_notnull(df: DataFrame, *cols: str) -> DataFrame:
    return where(df, *[F.col(c).isNotNull() for c in cols])


def where_contains(df: DataFrame, c: str, text: str) -> DataFrame:
    return df.filter(F.col(c).contains(text))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def replace(df: DataFrame, c: str, values: Mapping) -> DataFrame:
    """Map listed values of one column; a None key stands for NULL, other values stay."""
    col = F.col(c)
    out = col
    for old, new in values.items():
        out = F.when(col.isNull() if old is None else col == F.lit(old), F.lit(new)).otherwise(out)
    return df.withColumn(c, out)


def backfill(
    df: DataFrame, cols: Sequence[str], order: Order, by: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Replace NULL by the next non-NULL value in order.

    Beyond one task's rows the gaps are numbered by a running count from the end, and the one
    value that closes each gap is joined back to it.
    """
    if fits_one_task(df, by, group_rows):
        ahead = window(by, order).rowsBetween(0, W.unboundedFollowing)
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in cols})
    reverse = [_flip(o) for o in order]
    for c in cols:
        df = running(df, by, reverse, {"_gap": ("count", F.col(c))}, group_rows)
        closing = df.groupBy(*by, "_gap").agg(F.max(c).alias("_v"))
        df = join_groups(df, closing, [*by, "_gap"], "left").withColumn(c, F.coalesce(F.col(c), F.col("_v"))).drop("_gap", "_v")
    return df


def _flip(o) -> Column:
    if not isinstance(o, str):
        raise TypeError("name the order columns; they are reversed here")
    return F.col(o).desc()


def cast(df: DataFrame, c: str, to: str) -> DataFrame:
    """Cast; text that does not parse becomes NULL, a fraction cast to a whole number is cut off."""
    return df.withColumn(c, F.col(c).try_cast(to))


def choose(cond: Column, a, b) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond, as_col(a)).otherwise(as_col(b))


def clip(c: Column | str, lo=None, hi=None) -> Column:
    """Bound a value on either side; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    out = c if lo is None else F.greatest(c, F.lit(lo))
    out = out if hi is None else F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def flag_any(cols: Sequence[str]) -> Column:
    """1 if any of the columns is above zero, else 0."""
    return (F.coalesce(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]), F.lit(0)) > 0).cast("int")


def flag_present(c: str) -> Column:
    """1 where a value is present."""
    return F.col(c).isNotNull().cast("int")


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns; a missing value adds nothing."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def assign_treatment(df: DataFrame, t: str, delta: float = 1.0) -> DataFrame:
    """The same rows with the treatment moved by ``delta``."""
    return df.withColumn(t, F.col(t) + F.lit(delta))


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop the columns that are NULL in every row (one pass, one row of counts)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def with_const(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply named whole-table steps one after another."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def cols_of_type(df: DataFrame, *types: str) -> list[str]:
    return [c for c, t in df.dtypes if t in types]
