"""Registration of queries and helpers they share."""

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = (
    "sources_q", "relational_q", "joins_q", "aggregates_q", "windows_q", "rows_q", "scalars_q", "reshape_q",
    "charts_q", "stats_q", "regression_q", "causal_q", "features_q", "models_q", "baskets_q", "recommend_q",
    "graph_q", "bandit_q", "streaming_q", "udf_q",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"tabulon.queries.{family}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rnd(c: Column | str, d: int = 6) -> Column:
    """Rounded double without negative zero, so both engines print it alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), d) + F.lit(0.0)


def R(sql: str, d: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(round(cast({sql} as double), {d}) + 0e0)"


def H(*cols: str, seed: int) -> str:
    """SQL text of the 40-bit number that ``rows.hashed`` makes of the same keys."""
    keys = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 10) as bigint)"


def U(*cols: str, seed: int) -> str:
    """SQL text of ``rows.uniform``."""
    return f"({H(*cols, seed=seed)} / {float(1 << 40)!r}::double)"


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
