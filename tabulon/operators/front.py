"""Rows that no other row beats in two goals at once (Pareto front)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.plans.ordered import running
from tabulon.plans.shared import cut

# A task keeps a front of so many rows; what exceeds it is passed on and left to the merge.
HELD = 100_000


def on_front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the points no other is at most as large as in both goals and smaller in one; equal points stay together."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    # The least b among points of a smaller a, and whether b is the least of its own a.
    best = np.minimum.accumulate(y)
    first = np.searchsorted(x, x, "left")
    before = np.where(first > 0, best[np.maximum(first - 1, 0)], np.inf)
    out = np.empty(len(a), bool)
    out[order] = (y < before) & (y == y[first])
    return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The front of a task: each batch is filtered by what has been seen, and joins it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        both = pa.Table.from_batches([*held, batch])
        keep = on_front(both.column(0).to_numpy(), both.column(1).to_numpy())
        held = both.filter(pa.array(keep)).combine_chunks().to_batches()
        if sum(b.num_rows for b in held) > HELD:
            yield from held
            held = []
    yield from held


def pareto_front(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of ``df`` for which no other row is as small in both goals and smaller in one.

    Every task sends on its own front. What is left is decided without bringing it together: the
    least second goal up to each value of the first, by a running minimum, and the first place
    where that minimum is reached. Equal rows stay together; rows that miss a goal, or hold NaN
    there, take no part.
    """
    a, b = (F.col(f"`{c}`").cast("double") for c in (first, second))
    rows = df.select(a.alias("_a"), b.alias("_b"), F.struct("*").alias("_row"))
    rows = rows.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.isnan("_a") & ~F.isnan("_b"))
    left = cut(rows.mapInArrow(_local, rows.schema))
    per = left.groupBy("_a").agg(F.min("_b").alias("_low"))
    steps = running(per, [], ["_a"], {"_least": ("min", "_low")}).groupBy("_least").agg(F.min("_a").alias("_at"))
    return left.join(steps, (F.col("_a") == F.col("_at")) & (F.col("_b") == F.col("_least"))).select("_row.*")
