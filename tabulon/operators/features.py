"""Scaling, encoding and term weights."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.operators.windows import adstock
from tabulon.plans.ordered import Order, with_position
from tabulon.plans.quantiles import quantile_table
from tabulon.plans.sizes import join_groups, with_scalars


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); NULL for a constant column."""
    s = df.agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = with_scalars(df, s).withColumns(
        {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in cols}
    )
    return out.drop(*s.columns)


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population spread."""
    s = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = with_scalars(df, s).withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols})
    return out.drop(*s.columns)


def scale_robust(df: DataFrame, cols: Sequence[str], **limits) -> DataFrame:
    """(x - median) / interquartile range, with exact quantiles."""
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], **limits)
    at = lambda c, p: F.max(F.when((F.col("variable") == c) & (F.col("prob") == F.lit(p)), F.col("value")))
    s = q.agg(*[x for c in cols for x in (at(c, 0.5).alias(f"_m_{c}"), (at(c, 0.75) - at(c, 0.25)).alias(f"_r_{c}"))])
    out = with_scalars(df, s).withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_r_{c}")) for c in cols})
    return out.drop(*s.columns)


def index_items(df: DataFrame, c: str, name: str = "code", group_rows: int | None = None) -> DataFrame:
    """The dictionary (value, code): sorted distinct values numbered from 0."""
    values = df.select(c).filter(F.col(c).isNotNull()).distinct()
    return with_position(values, [], [c], name, group_rows).withColumn(name, F.col(name) - 1)


def label_encode(df: DataFrame, c: str, name: str | None = None, group_rows: int | None = None) -> DataFrame:
    name = name or f"{c}_code"
    return join_groups(df, index_items(df, c, name, group_rows), [c], "left")


def ordinal_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes for several columns; every dictionary is built from the table as it came."""
    out = df
    for c in cols:
        out = join_groups(out, index_items(df, c, f"{c}_code"), [c], "left")
    return out


def target_encode(train: DataFrame, df: DataFrame, c: str, y: str, name: str | None = None) -> DataFrame:
    """Mean outcome of the category in the training rows; unknown categories get the training mean."""
    name = name or f"{c}_target"
    means = train.groupBy(c).agg(F.avg(y).alias(name))
    overall = train.select(F.avg(y)).scalar()
    return join_groups(df, means, [c], "left").withColumn(name, F.coalesce(F.col(name), overall))


def tfidf(df: DataFrame, doc: str, term: str, count: str) -> DataFrame:
    """Weights count * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per document.

    ``df`` has one row per (doc, term).
    """
    n = df.select(F.count_distinct(doc)).scalar()
    seen = df.groupBy(term).agg(F.count("*").alias("_df"))
    raw = join_groups(df, seen, [term])
    raw = raw.withColumn("_w", F.col(count) * (F.log((1 + n) / (1 + F.col("_df"))) + 1))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    out = join_groups(raw, norm, [doc])
    return out.withColumn("tfidf", F.col("_w") / F.col("_norm")).drop("_df", "_w", "_norm")


def basket_matrix(df: DataFrame, by: str, item: str) -> DataFrame:
    """One row per (basket, item) with value 1: the long form of the one-hot matrix."""
    return df.select(by, item).distinct().withColumn("value", F.lit(1))


def adstock_features(df: DataFrame, alphas: Mapping[str, float], order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Carry-over features of several channels."""
    return adstock(df, alphas, order, by)
