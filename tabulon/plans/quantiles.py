"""Exact quantiles (linear interpolation) at any number of distinct values."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.plans.ordered import running
from tabulon.plans.sizes import DISTINCT_VALUES, join_groups


def quantile_table(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    distinct_values: int | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Long table (by..., variable, prob, value).

    ``percentile`` keeps every distinct value of a group in one buffer, so it is used only when
    an approximate distinct count shows that this is small; otherwise value counts are run up in
    order and the wanted ranks are picked out of them.
    """
    limit = DISTINCT_VALUES if distinct_values is None else distinct_values
    seen = df.groupBy(*by).agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    widest = seen.agg(F.greatest(*[F.max(c) for c in cols], F.lit(0))).first()[0] or 0
    if widest <= limit:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        wide = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), grid).alias(c) for c in cols])
        named = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("q")) for c in cols]))
        long = wide.select(*by, named.alias("_v")).select(*by, "_v.variable", "_v.q")
        long = long.withColumn("q", F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), len(probs))))
        return long.select(*by, "variable", F.explode(F.arrays_zip(grid.alias("prob"), F.col("q").alias("value"))).alias("_q")).select(
            *by, "variable", "_q.prob", "_q.value"
        )
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "variable", "value"
    )
    keys = [*by, "variable"]
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    present = counts.filter(F.col("value").isNotNull())
    grid = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    ranked = running(present, keys, ["value"], {"_upto": ("sum", "_n")}, group_rows)
    totals = counts.groupBy(*keys).agg(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))).alias("_total"))
    wanted = join_groups(ranked, totals, keys).select("*", grid)
    h = F.col("prob") * (F.col("_total") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    holds = lambda i: (i >= F.col("_upto") - F.col("_n")) & (i < F.col("_upto"))
    picked = (
        wanted.filter(holds(lo) | holds(hi))
        .groupBy(*keys, "prob")
        .agg(
            F.max(F.when(holds(lo), F.col("value"))).alias("_a"),
            F.max(F.when(holds(hi), F.col("value"))).alias("_b"),
            F.max(h - lo).alias("_f"),
        )
    )
    value = (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value")
    # A group without any value keeps its rows, with NULL quantiles.
    return join_groups(totals.select(*keys, grid), picked.select(*keys, "prob", value), [*keys, "prob"], "left")


def quantiles_wide(df: DataFrame, col: str, named: dict[str, float], by: Sequence[str] = (), **limits) -> DataFrame:
    """One row per group with one named column per probability."""
    long = quantile_table(df, [col], list(named.values()), by, **limits)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
    )


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """The q+1 edges of equal-count bins, as plain numbers."""
    probs = [i / q for i in range(q + 1)]
    rows = quantile_table(df, [col], probs).select("prob", "value").collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["prob"])]
