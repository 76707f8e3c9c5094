"""The tables behind common charts: bins, box numbers, intervals, densities. Nothing is drawn here."""

from collections.abc import Sequence
from functools import reduce
from operator import add
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.aggregates import value_counts
from tabulon.operators.rows import uniform
from tabulon.plans.quantiles import quantile_table, quantiles_wide
from tabulon.plans.sizes import join_groups, with_scalars


def _binned(df: DataFrame, c: str, bins: int) -> DataFrame:
    ranged = with_scalars(df.filter(F.col(c).isNotNull()), df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.greatest(F.lit(0), F.least(F.floor(F.try_divide(F.col(c) - F.col("_lo"), width)), F.lit(bins - 1)))
    # A column of one value has no width; all of it is in the first bin.
    return ranged.withColumn("bin", F.when(width > 0, at).otherwise(0).cast("long")).withColumn("_w", width)


def histogram(df: DataFrame, c: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the whole range; the last bin is closed on the right."""
    return _binned(df, c, bins).groupBy(*by, "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        F.min(F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
        F.count("*").alias("n"),
    )


def box_stats(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR and the number of rows outside."""
    q = quantiles_wide(df, c, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(c).between(F.col("q1") - reach, F.col("q3") + reach)
    return join_groups(df.select(*by, c), q, by).groupBy(*by).agg(
        *[F.first(n).alias(n) for n in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(c))).alias("low"),
        F.max(F.when(inside, F.col(c))).alias("high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def count_plot(df: DataFrame, c: str) -> DataFrame:
    """Count per category with a printable label."""
    return value_counts(df, c).withColumn("label", F.concat_ws(": ", F.col(c).cast("string"), F.col("n").cast("string")))


def mean_ci(df: DataFrame, by: Sequence[str], c: str, z: float = 1.96) -> DataFrame:
    """Group mean with a normal interval (mean +/- z * s / sqrt(n))."""
    stats = df.groupBy(*by).agg(F.avg(c).alias("mean"), (F.lit(z) * F.stddev_samp(c) / F.sqrt(F.count(c))).alias("_h"))
    return stats.select(*by, "mean", (F.col("mean") - F.col("_h")).alias("low"), (F.col("mean") + F.col("_h")).alias("high"))


# A Poisson count of mean one is at least 1, 2, 3, .. beyond these chances.
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], c: str, key: Sequence[str], replicates: int = 200, seed: int = 1, level: float = 0.95
) -> DataFrame:
    """Group mean with a percentile interval over resampled means.

    In each replicate a row counts as often as a Poisson draw of mean one says, which for many rows
    is drawing with replacement. Draws go by hash of the row's key, so one aggregate, partial in
    every task, makes all replicates and no row is moved.
    """
    present = df.filter(F.col(c).isNotNull()).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform([*key, "_r"], seed)
    weight = reduce(add, [(u >= F.lit(p)).cast("int") for p in POISSON_ONE])
    sums = present.withColumn("_w", weight).groupBy(*by, "_r").agg(F.sum(F.col("_w") * F.col(c)).alias("_s"), F.sum("_w").alias("_n"))
    # One row per group and replicate is left.
    means = sums.withColumn("_m", F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double")))
    tail = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"))
    return join_groups(df.groupBy(*by).agg(F.avg(c).alias("mean")), ends, by, "left")


def binned_mean(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean of y in equal-width bins of x."""
    return _binned(df, x, bins).groupBy("bin").agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(y).alias("n")
    )


def kde(
    df: DataFrame, c: str, points: int, by: Sequence[str] = (), bandwidth: float | None = None, per_width: int | None = 8
) -> DataFrame:
    """Gaussian kernel density on an even grid over the whole range.

    Rows are counted into bins of ``bandwidth / per_width`` first, so bins stay narrow beside the
    kernel however far an outlier lies; None counts equal values only and is exact. Counts meet the
    grid, a fixed list, inside their tasks. The bandwidth defaults to Scott's rule, s * n^(-1/5),
    per group. A group without spread has no density (NULL).
    """
    present = df.filter(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias("_v"))
    ranged = with_scalars(present, present.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    size = present.groupBy(*by).agg(F.count("_v").alias("_all"), F.stddev_samp("_v").alias("_s"))
    h = F.lit(float(bandwidth)) if bandwidth else F.col("_s") * F.pow(F.col("_all"), F.lit(-0.2))
    rows = join_groups(ranged, size, by).withColumn("_h", h)
    step = F.col("_h") / F.lit(float(per_width or 1))
    binned = F.col("_lo") + (F.floor((F.col("_v") - F.col("_lo")) / step) + 0.5) * step
    mid = F.when(step > 0, binned).otherwise(F.col("_v")) if per_width else F.col("_v")
    counts = rows.groupBy(*by, mid.alias("_mid"), "_lo", "_hi", "_all", "_h").agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.select("*", F.explode(F.array(*[F.lit(i) for i in range(points)])).alias("point"))
    at = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    z = F.try_divide(at - F.col("_mid"), F.col("_h"))
    weight = F.try_divide(F.col("_n") * F.exp(-0.5 * z * z), F.col("_all") * F.col("_h") * F.sqrt(2 * F.pi()))
    return spread.groupBy(*by, F.col("point").cast("long").alias("point")).agg(F.min(at).alias("x"), F.sum(weight).alias("density"))


def qq(df: DataFrame, c: str, n: int) -> DataFrame:
    """Sample quantiles beside normal quantiles at n even probabilities."""
    probs = [(i - 0.5) / n for i in range(1, n + 1)]
    normal = {p: NormalDist().inv_cdf(p) for p in probs}
    sample = quantile_table(df, [c], probs).select("prob", F.col("value").alias("sample"))
    theory = F.create_map(*[F.lit(v) for p in probs for v in (float(p), float(normal[p]))])
    return sample.withColumn("theoretical", theory[F.col("prob")])


def smooth(df: DataFrame, x: str, y: str, bins: int = 50, span: float = 0.3) -> DataFrame:
    """Smooth trend of y on x: at each bin a straight line fitted to the binned means near it.

    Weights fall off by the tricube rule over ``span`` of the range. Only bin means meet the grid.
    """
    means = _binned(df, x, bins).groupBy("bin").agg(
        F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.count(y).alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    spread = means.withColumn("point", F.explode(F.array(*[F.lit(i) for i in range(bins)])))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.col("_lo") + (F.col("point") + 0.5) * width
    u = F.abs(F.col("_x") - at) / (F.lit(span) * (F.col("_hi") - F.col("_lo")))
    w = F.when(u < 1, F.pow(1 - F.pow(u, F.lit(3.0)), F.lit(3.0)) * F.col("_n"))
    d: Column = F.col("_x") - F.col("_at")
    sums = (
        spread.withColumn("_at", at).withColumn("_wt", w).filter("_wt > 0")
        .groupBy("point", "_at")
        .agg(
            F.sum("_wt").alias("s0"), F.sum(F.col("_wt") * d).alias("s1"), F.sum(F.col("_wt") * d * d).alias("s2"),
            F.sum(F.col("_wt") * F.col("_y")).alias("t0"), F.sum(F.col("_wt") * d * F.col("_y")).alias("t1"),
        )
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), det)
    return sums.select(
        F.col("point").cast("long").alias("point"), F.col("_at").alias("x"),
        F.coalesce(line, F.col("t0") / F.col("s0")).alias("trend"),
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows and non-NULL rows, from one pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("n_rows"), F.col(c).alias("n_present"))
        for c, t in df.dtypes
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
