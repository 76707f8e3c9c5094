"""Ordered work (positions, neighbours, running totals) that survives a hot key.

When every group fits one task the plan is a plain window. Otherwise the table is range-sorted
over (keys, order), which splits a hot key over many tasks; rows get positions from per-partition
counts, and windows run on fixed-size blocks of positions with a few neighbour rows copied in.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql import Window as W

from tabulon.plans.shared import cut
from tabulon.plans.sizes import GROUP_ROWS, join_groups, largest_group

BLOCK_ROWS = 250_000
Order = Sequence[Column | str]


def _order(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def window(by: Sequence[str], order: Order) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*_order(order))


def fits_one_task(df: DataFrame, by: Sequence[str], group_rows: int | None) -> bool:
    return largest_group(df, by) <= (GROUP_ROWS if group_rows is None else group_rows)


def with_position(
    df: DataFrame, by: Sequence[str], order: Order, name: str = "pos", group_rows: int | None = None
) -> DataFrame:
    """Position 1..n inside each group. ``order`` should end in a unique key."""
    if fits_one_task(df, by, group_rows):
        return df.withColumn(name, F.row_number().over(window(by, order)).cast("long"))
    return _sorted_position(df, by, order, name)


def _sorted_position(df: DataFrame, by: Sequence[str], order: Order, name: str) -> DataFrame:
    # The range bounds are sampled, so the sorted table is written once before it is used twice.
    placed = cut(
        df.orderBy(*[F.col(b).asc_nulls_first() for b in by], *_order(order)).withColumn(
            "_id", F.monotonically_increasing_id()
        )
    )
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_local", F.col("_id").bitwiseAND((1 << 33) - 1)
    )
    # A group lies together in a sort partition: where it begins there, and how many of its rows lie in
    # earlier partitions. One row per partition and group, so a hot group never meets in one place.
    pieces = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    earlier = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = pieces.select("_part", *by, (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_start"))
    whole = join_groups(placed, starts, ["_part", *by])
    return whole.withColumn(name, F.col("_start") + F.col("_local") + 1).drop("_id", "_part", "_local", "_start")


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    exprs: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead."""
    if fits_one_task(df, by, group_rows):
        return df.withColumns(dict(exprs(window(by, order))))
    size = max(block_rows or BLOCK_ROWS, before, after, 1)
    placed = _sorted_position(df, by, order, "_pos")
    block = F.floor((F.col("_pos") - 1) / F.lit(size))
    offset = (F.col("_pos") - 1) % F.lit(size)
    # A row is also context for the next block (it lies within `before` of its end)
    # and for the previous one (it lies within `after` of its start).
    homes = F.filter(
        F.array(
            block,
            F.when(offset >= size - before, block + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (block > 0), block - 1) if after else F.lit(None).cast("long"),
        ),
        lambda b: b.isNotNull(),
    )
    spread = placed.withColumn("_own", block).withColumn("_block", F.explode(homes))
    done = spread.withColumns(dict(exprs(window([*by, "_block"], ["_pos"]))))
    return done.filter(F.col("_block") == F.col("_own")).drop("_block", "_own", "_pos")


_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    measures: Mapping[str, tuple[str, str | Column]],
    group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Running sum, count, min or max up to and including each row.

    ``measures`` maps an output name to (function, column).
    """
    if fits_one_task(df, by, group_rows):
        spec = window(by, order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: _FIRST[f](c).over(spec) for n, (f, c) in measures.items()})
    size = block_rows or BLOCK_ROWS
    placed = _sorted_position(df, by, order, "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / F.lit(size)))
    spec = window([*by, "_block"], ["_pos"]).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({n: _FIRST[f](c).over(spec) for n, (f, c) in measures.items()})
    totals = placed.groupBy(*by, "_block").agg(*[_FIRST[f](c).alias(f"_t_{n}") for n, (f, c) in measures.items()])
    # The block totals are far fewer rows and are run through the same function.
    carried = running(
        totals,
        by,
        ["_block"],
        {f"_c_{n}": ("sum" if f == "count" else f, f"_t_{n}") for n, (f, _) in measures.items()},
    ).drop(*[f"_t_{n}" for n in measures])
    carried = carried.withColumn("_block", F.col("_block") + 1)
    both = join_groups(local, carried, [*by, "_block"], "left")
    merged = {}
    for n, (f, _) in measures.items():
        here, earlier = F.col(n), F.col(f"_c_{n}")
        if f in ("sum", "count"):
            merged[n] = F.when(here.isNull(), earlier).otherwise(here + F.coalesce(earlier, F.lit(0)))
        else:
            merged[n] = (F.least if f == "min" else F.greatest)(here, earlier)
    return both.withColumns(merged).drop("_block", "_pos", *[f"_c_{n}" for n in measures])


# Up to this k Spark cuts each group down in the map tasks already.
MAP_SIDE_RANK = 1000


def first_per_group(df: DataFrame, by: Sequence[str], order: Order, k: int = 1) -> DataFrame:
    """First k rows of each group. The rank filter is applied on the map side before the shuffle."""
    if k > MAP_SIDE_RANK:
        return with_position(df, by, order, "_rn").filter(F.col("_rn") <= k).drop("_rn")
    ranked = df.withColumn("_rn", F.row_number().over(window(by, order)))
    return ranked.filter(F.col("_rn") <= k).drop("_rn")
