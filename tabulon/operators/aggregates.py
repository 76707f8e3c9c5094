"""Group aggregates. All are built-in aggregates, so every map task sends one partial row per group."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.plans.ordered import Order, with_position
from tabulon.plans.quantiles import quantile_table, quantiles_wide

_FUNCTIONS = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp,
    "var": F.var_samp, "std_pop": F.stddev_pop, "var_pop": F.var_pop, "nunique": F.count_distinct,
}


def agg(df: DataFrame, by: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Named aggregates: output name -> (function, column)."""
    return df.groupBy(*by).agg(*[_FUNCTIONS[f](c).alias(n) for n, (f, c) in measures.items()])


def agg_many(df: DataFrame, by: Sequence[str], c: str, fns: Sequence[str]) -> DataFrame:
    """Several functions of one column."""
    return agg(df, by, {f"{c}_{f}": (f, c) for f in fns})


def size(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def nunique(df: DataFrame, c: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(fn(c).alias("n_unique"))


def value_counts(df: DataFrame, c: str, normalize: bool = False) -> DataFrame:
    """Rows per value, optionally with the fraction of all rows."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    return share(counts, [c], "n", "fraction", keep=["n"]) if normalize else counts


def share(df: DataFrame, by: Sequence[str], c: str, name: str = "share", keep: Sequence[str] = ()) -> DataFrame:
    """Each group's part of the grand total. The total is a scalar subquery over the group sums."""
    sums = df.groupBy(*by).agg(F.sum(c).alias("_sum"), *[F.max(k).alias(k) for k in keep])
    total = sums.select(F.sum("_sum").cast("double")).scalar()
    return sums.select(*by, *keep, F.try_divide(F.col("_sum").cast("double"), total).alias(name))


def collect_groups(
    df: DataFrame, by: Sequence[str], c: str, part_rows: int = 100_000, group_rows: int | None = None
) -> DataFrame:
    """Sorted set of distinct values per group, in parts of bounded length (one part for most groups)."""
    values = df.select(*by, c).filter(F.col(c).isNotNull()).distinct()
    return collect_ordered(values, by, c, [c], part_rows, group_rows)


def collect_ordered(
    df: DataFrame, by: Sequence[str], c: str, order: Order, part_rows: int = 100_000, group_rows: int | None = None
) -> DataFrame:
    """Ordered list per group, in parts of at most ``part_rows`` so that no row holds a hot group."""
    placed = with_position(df, by, order, "_pos", group_rows)
    part = F.floor((F.col("_pos") - 1) / F.lit(part_rows)).cast("long")
    lists = placed.withColumn("part", part).groupBy(*by, "part").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(c).alias("_v")))).alias("_l")
    )
    return lists.select(*by, "part", F.transform("_l", lambda x: x["_v"]).alias(c))


def quantiles(df: DataFrame, c: str, qs: Sequence[float], by: Sequence[str] = (), **limits) -> DataFrame:
    return quantile_table(df, [c], qs, by, **limits).drop("variable")


def median(df: DataFrame, c: str, by: Sequence[str] = (), **limits) -> DataFrame:
    return quantiles_wide(df, c, {"median": 0.5}, by, **limits)


def iqr(df: DataFrame, c: str, by: Sequence[str] = (), **limits) -> DataFrame:
    wide = quantiles_wide(df, c, {"q1": 0.25, "q3": 0.75}, by, **limits)
    return wide.select(*by, "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def describe(df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75), **limits) -> DataFrame:
    """Long table (variable, stat, value): count, mean, std, min, percentiles, max."""
    fns = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(c).cast("double").alias(f"{c}|{s}") for c in cols for s, fn in fns.items()])
    cells = [
        F.struct(F.lit(c).alias("variable"), F.lit(s).alias("stat"), F.col(f"{c}|{s}").alias("value"))
        for c in cols
        for s in fns
    ]
    basic = row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    pct = quantile_table(df, cols, qs, **limits).select(
        "variable", F.concat(F.format_string("%.0f", F.round(F.col("prob") * 100, 0)), F.lit("%")).alias("stat"), "value"
    )
    return basic.unionByName(pct)


def mode(df: DataFrame, c: str) -> DataFrame:
    """All most frequent values."""
    counts = value_counts(df, c)
    top = counts.select(F.max("n")).scalar()
    return counts.filter(F.col("n") == top).select(c, "n")


def skew(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected sample skewness; NULL below three rows."""
    n = F.col("_n")
    base = df.groupBy(*by).agg(F.count(c).alias("_n"), F.skewness(c).alias("_g"))
    return base.select(*by, F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))


def sum_all(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of every other column per group, in key order."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rest]).orderBy(*by)


def having(df: DataFrame, by: Sequence[str], measure: Column, cond: Column) -> DataFrame:
    return df.groupBy(*by).agg(measure).filter(cond)


def segment_rates(df: DataFrame, outer: str, inner: str, flag: str) -> DataFrame:
    """Rate of a 0/1 flag by (outer, inner) and by outer alone, in one pass."""
    rolled = df.rollup(outer, inner).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate")
    )
    level = F.when(F.col("_g") == 0, "segment").otherwise("overall")
    return rolled.filter("_g in (0, 1)").select(outer, inner, level.alias("level"), "n", "rate")


def cond_avg(df: DataFrame, conds: Mapping[str, Column], c: str) -> DataFrame:
    """Means under several conditions in one pass."""
    return df.agg(*[F.avg(F.when(cond, F.col(c))).alias(n) for n, cond in conds.items()])


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).count().fillna(0)


def mean_lower_bound(df: DataFrame, by: Sequence[str], c: str, z: float = 1.96) -> DataFrame:
    """Groups whose mean is above zero even at the lower end of its interval."""
    stats = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("_s"), F.count(c).alias("n"))
    low = F.col("mean") - F.lit(z) * F.col("_s") / F.sqrt("n")
    return stats.withColumn("lower", low).drop("_s").filter("lower > 0")


def avg_positive(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(c) > 0, F.col(c))).alias("avg_positive"))


def ratio(df: DataFrame, num: Column, den: Column, name: str = "ratio") -> DataFrame:
    """Whole-table ratio of two aggregates; NULL for a zero denominator."""
    return df.agg(F.try_divide(num.cast("double"), den.cast("double")).alias(name))


def get_group(df: DataFrame, by: Mapping[str, object]) -> DataFrame:
    for k, v in by.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def daily_sum(df: DataFrame, ts: str, cols: Sequence[str], unit: str = "day") -> DataFrame:
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bucket")
    return df.groupBy(bucket).agg(*[F.sum(c).alias(c) for c in cols])


def audit_assignment(
    df: DataFrame, worker: str, day: str, slot: str, need: Mapping[str, int], load: int
) -> DataFrame:
    """Violations of a roster: too few workers in a slot, a worker off the exact load, two slots on one day.

    Slots without any row are not seen here; pass a table that lists them with a NULL worker.
    """
    cover = df.groupBy(day, slot).agg(F.count_distinct(worker).alias("found"))
    wanted = F.coalesce(*[F.when(F.col(slot) == F.lit(s), F.lit(n)) for s, n in need.items()], F.lit(0)).cast("long")
    short = cover.withColumn("wanted", wanted).filter("found < wanted")
    loads = df.filter(F.col(worker).isNotNull()).groupBy(worker).agg(F.count("*").alias("found"))
    doubles = df.filter(F.col(worker).isNotNull()).groupBy(worker, day).agg(F.count("*").alias("found"))
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    return (
        short.select(F.lit("cover").alias("rule"), text(day, slot).alias("where"), "found", "wanted")
        .unionByName(
            loads.filter(F.col("found") != load).select(
                F.lit("load").alias("rule"), text(worker).alias("where"), "found", F.lit(load).cast("long").alias("wanted")
            )
        )
        .unionByName(
            doubles.filter("found > 1").select(
                F.lit("one_slot").alias("rule"), text(worker, day).alias("where"), "found", F.lit(1).cast("long").alias("wanted")
            )
        )
    )
