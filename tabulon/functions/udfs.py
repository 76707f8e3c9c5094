"""User-written Python on columns, groups and tables.

Python sees Arrow batches only. Group figures are aggregated by Spark and handed to the function
beside the rows, so that no function ever needs a whole group in one place.
"""

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.scalars import digitize
from tabulon.plans.quantiles import quantile_edges
from tabulon.plans.sizes import join_groups


def map_col(df: DataFrame, c: str, fn: Callable, to: str, name: str | None = None, batches: bool = False) -> DataFrame:
    """Element-wise function of a Column, or of a pandas Series when ``batches`` is set."""
    value = F.pandas_udf(lambda s: fn(s), to)(F.col(c)) if batches else fn(F.col(c)).cast(to)
    return df.withColumn(name or c, value)


def map_group(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, Column], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Row-preserving function of a row and its group's figures, on batches of any size."""
    rows = join_groups(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return rows.mapInPandas(run, schema)


def udaf(
    df: DataFrame, by: Sequence[str], partial: Callable[[pd.DataFrame], pd.Series], sums: Sequence[str], finish: Mapping[str, Column]
) -> DataFrame:
    """User-defined aggregate in three steps: Python partials per batch, summed by Spark, finished as a Column.

    ``partial`` maps the rows of one key in one batch to the numbers named in ``sums``.
    """
    fields = ", ".join([f"`{k}` {dict(df.dtypes)[k]}" for k in by] + [f"`{s}` double" for s in sums])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [[*(k if isinstance(k, tuple) else (k,)), *partial(g)[list(sums)]] for k, g in b.groupby(list(by), dropna=False)]
            yield pd.DataFrame(rows, columns=[*by, *sums])

    merged = df.mapInPandas(run, fields).groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
    return merged.select(*by, *[c.alias(n) for n, c in finish.items()])


def make_binner(train: DataFrame, c: str, q: int) -> Callable[[Column | str], Column]:
    """Bins learnt on one table, as a function to be used on any table."""
    edges = quantile_edges(train, c, q)
    return lambda col: digitize(col, edges)


# Rows that one row has become, held at a time.
EXPANDED = 10_000


def expand_rows(df: DataFrame, fn: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """Generator from one row to many, run batch by batch and sent on in pieces of EXPANDED rows."""
    names = [p.strip().split()[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = (made for row in b.itertuples(index=False) for made in fn(row))
            while piece := list(islice(out, EXPANDED)):
                yield pd.DataFrame(piece, columns=names)

    return df.mapInPandas(run, schema)
