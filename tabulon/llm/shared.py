"""Small helpers of the text operators."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulon.plans.shared import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str) -> Column:
    """The text, a missing one counted as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Text of ASCII alone takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def stored(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write the table once in the shared folder and go on from there.

    Lineage ends here, so a lost executor costs a read, and the size of the files tells the
    planner which joins may broadcast. ``compact`` is for a few bytes made of each document: they
    are put together first, so that many map tasks do not leave as many tiny files.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a batch that a Python worker holds at a time: they are whole documents.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's batches for Python workers to BATCH_ROWS rows, or fewer if it asks for that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """left.key <=> right.other for all keys."""
    cond = None
    for a, b in keys.items():
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())
