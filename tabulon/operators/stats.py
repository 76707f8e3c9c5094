"""Covariance, tests and divergences. Figures come from built-in aggregates; p values from one number each."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.tails import p_chi2, p_f, p_t, studentized_range_sf
from tabulon.plans.sizes import join_groups, small_rows, with_scalars


def _matrix(df: DataFrame, cols: Sequence[str], fn, name: str) -> DataFrame:
    row = df.agg(*[fn(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{min(i, j)}_{max(i, j)}").alias(name))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows that have both values; NULL when either does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def cov(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance matrix in long form, all pairs of columns in one pass."""
    return _matrix(df, cols, F.covar_samp, "cov")


def corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _matrix(df, cols, pearson, "corr")


def mean_interval(df: DataFrame, c: str, k: float = 2.0) -> DataFrame:
    """Mean, standard error (population spread) and the mean +/- k errors."""
    se = F.stddev_pop(c) / F.sqrt(F.count(c))
    return df.agg(F.avg(c).alias("mean"), se.alias("se")).select(
        "mean", "se", (F.col("mean") - k * F.col("se")).alias("low"), (F.col("mean") + k * F.col("se")).alias("high")
    )


def ttest(df: DataFrame, c: str, by: str, a, b, alternative: str = "two-sided") -> DataFrame:
    """Two-sample t test with pooled variance."""
    g = {s: F.when(F.col(by) == F.lit(v), F.col(c)) for s, v in (("a", a), ("b", b))}
    row = df.agg(*[f(x).alias(f"{n}{s}") for s, x in g.items() for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    t = (F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))
    out = row.select(F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), t.alias("t"), dof.cast("long").alias("dof"))
    return out.withColumn("p", p_t(F.col("t"), F.col("dof"), alternative))


def _group_stats(df: DataFrame, c: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")).filter("n > 0")


def anova(df: DataFrame, c: str, by: str) -> DataFrame:
    """One-way analysis of variance from group counts, means and variances."""
    g = with_scalars(_group_stats(df, c, by), df.agg(F.avg(c).alias("_grand")))
    t = g.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), F.lit(2.0))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    out = t.select(((F.col("ssb") / d1) / (F.col("ssw") / d2)).alias("f"), d1.alias("dof_between"), d2.alias("dof_within"))
    return out.withColumn("p", p_f(F.col("f"), F.col("dof_between"), F.col("dof_within")))


def _observed(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells that occur, with the totals of their row and column."""
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("observed"))
    counts = join_groups(counts, counts.groupBy(a).agg(F.sum("observed").alias("_r")), [a])
    return join_groups(counts, counts.groupBy(b).agg(F.sum("observed").alias("_c")), [b])


def chi2_cells(df: DataFrame, a: str, b: str, absent: bool = True) -> DataFrame:
    """Observed and expected counts of each cell, absent cells as 0.

    Every level of a meets every level of b through an array, so absent cells are given for small
    level lists only; without them the levels have no limit.
    """
    seen = _observed(df, a, b)
    total = seen.select(F.sum("observed").cast("double")).scalar()
    expected = (F.col("_r") * F.col("_c") / total).alias("expected")
    if not absent:
        return seen.select(a, b, "observed", expected)
    rows, totals = seen.select(a, "_r").distinct(), seen.select(b, "_c").distinct()
    cols = [r[0] for r in small_rows(totals.select(b))]
    grid = rows.withColumn(b, F.explode(F.array(*[F.lit(v) for v in cols])))
    full = grid.join(seen.select(a, b, "observed"), [a, b], "left").fillna(0, ["observed"])
    return full.join(totals, b).select(a, b, "observed", expected)


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test; the continuity correction applies to a two-by-two table only.

    The expected counts of all cells add up to the rows, so the absent cells' share is what the
    others leave: they are never made, and either side may have any number of levels.
    """
    seen = chi2_cells(df, a, b, absent=False)
    o, e = F.col("observed"), F.col("expected")
    d = F.abs(o - e)
    # In a two-by-two table all distances are equal.
    fixed = d - F.least(F.lit(0.5), d)
    t = seen.agg(
        F.sum(d * d / e).alias("met"), F.sum(fixed * fixed / e).alias("yates"), (F.sum("observed") - F.sum("expected")).alias("absent"),
        F.count("*").alias("cells"), F.max(d).alias("d"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"),
    )
    # The absent cells of a two-by-two table share what is left evenly, and lie as far off as every cell.
    n, near = 4 - F.col("cells"), F.col("d") - F.least(F.lit(0.5), F.col("d"))
    lost = F.when(n > 0, n * n * near * near / F.col("absent")).otherwise(0.0)
    plain = F.col("met") + F.greatest(F.col("absent"), F.lit(0.0))
    out = t.select(F.when(F.col("dof") == 1, F.col("yates") + lost).otherwise(plain).alias("chi2"), "dof")
    return out.withColumn("p", p_chi2(F.col("chi2"), F.col("dof")))


def tukey(df: DataFrame, c: str, by: str) -> DataFrame:
    """All pairwise mean differences with the studentized range.

    The group figures are small; the pairs are made in tasks, one group against all later ones.
    """
    kind = dict(df.dtypes)[by]
    g = sorted(small_rows(_group_stats(df, c, by)), key=lambda r: r[by])
    names, k = [r[by] for r in g], len(g)
    n, m = np.array([r["n"] for r in g], float), np.array([r["m"] for r in g], float)
    mse = sum((r["n"] - 1) * (r["v"] or 0.0) for r in g) / (n.sum() - k) if n.sum() > k else float("nan")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                diff = m[i + 1 :] - m[i]
                q = np.abs(diff) / np.sqrt(mse / 2 * (1 / n[i] + 1 / n[i + 1 :]))
                p = [studentized_range_sf(float(x), k, int(n.sum()) - k) for x in q]
                yield pd.DataFrame({"group1": [names[i]] * len(q), "group2": names[i + 1 :], "diff": diff, "q": q, "p": p})

    later = df.sparkSession.range(max(k - 1, 0))
    return later.mapInPandas(pairs, f"group1 {kind}, group2 {kind}, diff double, q double, p double")


def kl(df: DataFrame, p: str, q: str) -> DataFrame:
    """Sum of p * ln(p / q) over paired rows; rows with p = 0 add nothing, and q = 0 beside p > 0 makes it infinite."""
    ratio = F.when(F.col(q) == 0, F.lit(float("inf"))).otherwise(F.log(F.try_divide(F.col(p), F.col(q))))
    term = F.when(F.col(p) > 0, F.col(p) * ratio).otherwise(0.0)
    return df.agg(F.sum(term).alias("kl"))


def jsd(df: DataFrame, p: str, q: str) -> DataFrame:
    """Jensen-Shannon divergence of two columns, each normalised to sum 1 first."""
    totals = df.agg(F.sum(p).cast("double").alias("_p"), F.sum(q).cast("double").alias("_q")).select(F.struct("*")).scalar()
    out = df.withColumn("_t", totals).select((F.col(p) / F.col("_t._p")).alias("p"), (F.col(q) / F.col("_t._q")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return out.agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("jsd"))
