"""Effects: differences in differences, panels, pre-tests, elasticities, double residuals, policies."""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.scalars import qcut
from tabulon.functions.tails import normal_sf, p_t
from tabulon.operators.reshape import levels
from tabulon.operators.rows import uniform
from tabulon.operators.windows import avg_rank, demean
from tabulon.plans.gram import Fit, Moments, Terms, all_present, as_terms, complete, fit_moments, inverse, moments
from tabulon.plans.ordered import Order
from tabulon.plans.shared import cut
from tabulon.plans.sizes import join_groups

# Time levels up to this many enter a two-way model as dummy columns.
TIME_DUMMIES = 40


def did(df: DataFrame, y: str, treated: Column, post: Column) -> DataFrame:
    """Two-by-two difference in differences and the untreated counterfactual point."""
    cells = {"t1": treated & post, "t0": treated & ~post, "c1": ~treated & post, "c0": ~treated & ~post}
    m = df.agg(*[F.avg(F.when(cond, F.col(y))).alias(n) for n, cond in cells.items()])
    trend = F.col("c1") - F.col("c0")
    return m.select(
        *cells, (F.col("t0") + trend).alias("counterfactual"), (F.col("t1") - F.col("t0") - trend).alias("effect")
    )


def _panel(df: DataFrame, y: str, xs: Terms, entity: str, time: str | None) -> tuple[DataFrame, dict[str, Column], int]:
    """Demeaned design; returns it, its terms and the number of time effects."""
    cols = as_terms(xs)
    base = df.select(
        entity, *([time] if time else []), *[c.alias(f"_x{i}") for i, c in enumerate(cols.values())],
        F.col(y).cast("double").alias("_y"),
    ).dropna(subset=[entity, *([time] if time else [])])
    names = [f"_x{i}" for i in range(len(cols))]
    base = base.filter(all_present([*names, "_y"]))
    terms = {n: F.col(x) for n, x in zip(cols, names)}
    if time is None:
        return demean(base, [entity], [*names, "_y"]), terms, 0
    times = base.select(F.count_distinct(time)).first()[0]
    if times <= TIME_DUMMIES:
        # Entity means come off by subtraction, time effects by dummies: exact for any panel.
        dummies = [f"_d{i}" for i in range(1, times)]
        base = base.withColumns({d: (F.col(time) == F.lit(v)).cast("double") for d, v in zip(dummies, levels(base, time)[1:])})
        flat = demean(base, [entity], [*names, "_y", *dummies])
        return flat, {**terms, **{d: F.col(d) for d in dummies}}, times - 1
    return _two_way(base, entity, time, [*names, "_y"]), terms, times - 1


# Rounds of alternating means before a panel counts as not solvable this way, and how small the means must get
# beside the spread of their column.
ROUNDS, NEAR_ZERO = 500, 1e-9


def _two_way(base: DataFrame, entity: str, time: str, names: Sequence[str]) -> DataFrame:
    """Take entity and time means off until both are zero.

    Only the means of the (entity, time) cells are worked on; rows are touched once, at the end.
    """
    cells = base.groupBy(entity, time).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in names])
    start = cells = cut(cells)
    spread = base.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    scale = {c: float(spread[c] or 0.0) or 1.0 for c in names}

    def less_means(table: DataFrame, by: str) -> DataFrame:
        means = table.groupBy(by).agg(*[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"_m{i}") for i, c in enumerate(names)])
        return join_groups(table, means, [by]).select(entity, time, "_n", *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(names)])

    for _ in range(ROUNDS):
        cells = cut(less_means(less_means(cells, entity), time))
        left = cells.groupBy(entity).agg(*[F.abs(F.sum(F.col("_n") * F.col(c)) / F.sum("_n") / scale[c]).alias(c) for c in names])
        worst = left.agg(F.greatest(*[F.max(c) for c in names], F.lit(0.0))).first()[0] or 0.0
        if worst < NEAR_ZERO:
            break
    else:
        raise RuntimeError(f"two-way means have not settled after {ROUNDS} rounds: {worst:.3g} of a standard deviation is left")
    ends = cells.select(entity, time, *[F.col(c).alias(f"_e{i}") for i, c in enumerate(names)])
    shift = join_groups(start, ends, [entity, time]).select(entity, time, *[(F.col(c) - F.col(f"_e{i}")).alias(f"_s{i}") for i, c in enumerate(names)])
    rows = join_groups(base, shift, [entity, time])
    return rows.withColumns({c: F.col(c) - F.col(f"_s{i}") for i, c in enumerate(names)}).drop(*[f"_s{i}" for i in range(len(names))])


def _without(m: Moments, k: int) -> Moments:
    """Moments of the first k columns and the last, after the columns between them (time dummies) are taken out."""
    keep, out = [*range(k), len(m.mean) - 1], list(range(k, len(m.mean) - 1))
    cross = m.cross[np.ix_(keep, keep)]
    if out:
        across = m.cross[np.ix_(keep, out)]
        cross = cross - across @ inverse(m.cross[np.ix_(out, out)]) @ across.T
    return Moments(m.n, np.zeros(len(keep)), cross, m.entities)


def fixed_effects(df: DataFrame, y: str, xs: Terms, entity: str, time: str | None = None) -> Fit:
    """Within estimator with entity effects, and time effects if a time column is named.

    The fit is of the named terms alone, with both effects taken out, however many time levels there are.
    """
    flat, terms, times = _panel(df, y, xs, entity, time)
    wanted = list(as_terms(xs))
    m = moments(complete(flat, "_y", terms, [entity]), len(terms), centred=True, entity=entity)
    return fit_moments(_without(m, len(wanted)), wanted, False, lost=m.entities + times)


def clustered(df: DataFrame, y: str, xs: Terms, entity: str, time: str | None = None) -> DataFrame:
    """Fixed effects with clustered errors: by entity, or by entity and time (Ve + Vt - Vet).

    Score sums are taken per cluster on the cluster; only k x k products come back. Errors are
    scaled by n / (n - k), k being the terms and the time effects.
    """
    flat, terms, times = _panel(df, y, xs, entity, time)
    keys = [entity, *([time] if time else [])]
    design = complete(flat, "_y", terms, keys)
    k = len(terms)
    fit = fit_moments(moments(design, k, centred=True), list(terms), False)
    resid = F.col("_y") - reduce(add, [F.lit(float(b)) * F.col(f"_x{i}") for i, b in enumerate(fit.coef)])
    scores = design.select(*keys, *[(F.col(f"_x{i}") * resid).alias(f"_s{i}") for i in range(k)])

    def meat(by: Sequence[str]) -> np.ndarray:
        sums = scores.groupBy(*by).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)])
        row = sums.agg(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    b = meat([entity])
    if time is not None:
        b = b + meat([time]) - meat(keys)
    wanted = list(as_terms(xs))
    v = fit.core @ b @ fit.core * fit.n / (fit.n - len(wanted) - times)
    rows = []
    for i, n in enumerate(wanted):
        se = float(np.sqrt(max(v[i, i], 0.0)))
        z = float(fit.coef[i]) / se if se else float("nan")
        rows.append((n, float(fit.coef[i]), se, z, 2 * normal_sf(abs(z))))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double")


def within_variation(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sum over groups of each column's spread inside the group: 0 for what never varies."""
    g = df.groupBy(*by).agg(*[F.stddev_samp(c).alias(c) for c in cols])
    return g.agg(*[F.sum(c).alias(c) for c in cols])


def pretest(df: DataFrame, y: str, d: str, x: str, by: Sequence[str], level: float = 0.05) -> DataFrame:
    """Per replicate: long and short slope of d, and the one a pre-test on x would report."""
    pairs = {"dd": (d, d), "xx": (x, x), "dx": (d, x), "dy": (d, y), "xy": (x, y), "yy": (y, y)}
    g = df.select(*by, *[F.col(c).cast("double").alias(c) for c in (y, d, x)]).groupBy(*by).agg(
        F.count("*").alias("n"), *[(F.covar_pop(a, b) * F.count("*")).alias(n) for n, (a, b) in pairs.items()]
    )
    c = F.col
    det = c("dd") * c("xx") - c("dx") * c("dx")
    g = g.filter((det > 0) & (c("n") > 3))
    long = (c("xx") * c("dy") - c("dx") * c("xy")) / det
    beta = (c("dd") * c("xy") - c("dx") * c("dy")) / det
    s2 = (c("yy") - long * c("dy") - beta * c("xy")) / (c("n") - 3)
    g = g.withColumns({"long": long, "short": c("dy") / c("dd"), "t": beta / F.sqrt(s2 * c("dd") / det)})
    g = g.withColumn("p", p_t(c("t"), c("n") - 3))
    chosen = F.when(c("p") < level, c("long")).otherwise(c("short"))
    return g.select(*by, "long", "short", "p", chosen.alias("pretest"))


def ovb(df: DataFrame, y: str, d: str, x: str) -> DataFrame:
    """Omitted-variable bias: (slope of y on x) times (slope of x on d)."""
    row = df.agg(
        (F.covar_samp(x, y) / F.var_samp(x)).alias("beta"), (F.covar_samp(d, x) / F.var_samp(d)).alias("delta")
    )
    return row.withColumn("ovb", F.col("beta") * F.col("delta"))


def elasticity(fit: Fit, terms: Terms, moved: Terms) -> Column:
    """Change of the prediction when the terms are replaced by the ``moved`` ones (treatment + 1)."""
    return fit.predict(moved) - fit.predict(terms)


def bands(df: DataFrame, cols: Sequence[str], q: int) -> DataFrame:
    """Equal-count bands 1..q of several columns, as ``<c>_band``."""
    for c in cols:
        df, _ = qcut(df, c, q, f"{c}_band")
    return df


def policy_value(df: DataFrame, selected: Column, y: str) -> DataFrame:
    """Gain per row of the whole table when only the selected rows are acted on."""
    return df.agg((F.sum(F.when(selected, F.col(y)).otherwise(0.0)) / F.count("*")).alias("value"))


def best_per_band(df: DataFrame, band: str, arm: str, y: str) -> DataFrame:
    """Every row with the arm of highest mean outcome in its band; a tied band has none."""
    means = df.groupBy(band, arm).agg(F.avg(y).alias("_m"))
    best = avg_rank(means, [band], "_m", "_r").filter("_r = 1").select(band, F.col(arm).alias("best"))
    return join_groups(df, best, [band])


def residual_pairs(df: DataFrame, y: str, t: str, xs: Terms, folds: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Out-of-fold residuals of outcome and treatment on the controls.

    Cross products are additive, so one pass per response gives every fold's training model as
    the total minus the fold.
    """
    cols = as_terms(xs)
    base = df.withColumn("_fold", F.floor(uniform(key, seed) * folds).cast("int"))
    out = base
    for resp, name in ((y, "_ry"), (t, "_rt")):
        per = moments(complete(base, resp, cols, ["_fold"]), len(cols), "_fold")
        total = _sum(list(per.values()))
        pred: Column | None = None
        for fold, m in per.items():
            p = fit_moments(total - m, list(cols)).predict(cols)
            pred = F.when(F.col("_fold") == fold, p) if pred is None else pred.when(F.col("_fold") == fold, p)
        out = out.withColumn(name, F.col(resp).cast("double") - pred)
    return out


def _sum(ms):
    n = sum(m.n for m in ms)
    mean = sum(m.n * m.mean for m in ms) / n
    cross = sum(m.cross + m.n * np.outer(m.mean - mean, m.mean - mean) for m in ms)
    return type(ms[0])(n, mean, cross)


def slope(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Residual slope with a heteroskedasticity-robust error."""
    g = df.groupBy(*by).agg(
        F.sum(F.col("_rt") * F.col("_ry")).alias("ty"), F.sum(F.col("_rt") * F.col("_rt")).alias("tt"),
        F.sum(F.pow(F.col("_rt") * F.col("_ry"), F.lit(2.0))).alias("a"),
        F.sum(F.pow(F.col("_rt"), F.lit(3.0)) * F.col("_ry")).alias("b"),
        F.sum(F.pow(F.col("_rt"), F.lit(4.0))).alias("c"), F.count("_ry").alias("n"),
    )
    theta = F.col("ty") / F.col("tt")
    meat = F.col("a") - 2 * theta * F.col("b") + theta * theta * F.col("c")
    out = g.select(*by, theta.alias("effect"), (F.sqrt(meat) / F.col("tt")).alias("se"), "n")
    z = F.col("effect") / F.col("se")
    return out.select(
        *by, "effect", "se", p_t(z, F.lit(1e7)).alias("p"), (F.col("effect") - 1.96 * F.col("se")).alias("low"),
        (F.col("effect") + 1.96 * F.col("se")).alias("high"), "n",
    )


def treatment_effects(
    df: DataFrame, y: str, treatments: Sequence[str], xs: Mapping[str, Column] | Sequence[str], folds: int, seed: int, key: Sequence[str]
) -> DataFrame:
    """Residual-on-residual effect of each treatment, the others joining the controls."""
    parts = []
    for t in treatments:
        controls = {**as_terms(xs), **as_terms([o for o in treatments if o != t])}
        parts.append(slope(residual_pairs(df, y, t, controls, folds, seed, key)).withColumn("treatment", F.lit(t)))
    return reduce(DataFrame.unionByName, parts)


def effect_by_segment(
    df: DataFrame, y: str, t: str, xs: Terms, segments: Sequence[str], folds: int, seed: int, key: Sequence[str]
) -> DataFrame:
    return slope(residual_pairs(df, y, t, xs, folds, seed, key), segments)


def policy(df: DataFrame, effect: str, cost: float, top: int | None = None, tie: Order = ()) -> DataFrame:
    """Treat where the effect exceeds its cost; optionally the best ``top`` rows by net gain."""
    out = df.withColumn("treat", F.when(F.col(effect) > cost, 1).otherwise(0)).withColumn("net", F.col(effect) - F.lit(cost))
    return out if top is None else out.filter("treat = 1").orderBy(F.col("net").desc(), *tie).limit(top)


def what_if(df: DataFrame, untreated: Column, y: str, effect: Column | float) -> DataFrame:
    """Mean outcome of the untreated rows now, and if they were treated."""
    effect = effect if isinstance(effect, Column) else F.lit(float(effect))
    row = df.filter(untreated).agg(F.avg(y).alias("now"), F.avg(F.col(y) + effect).alias("treated"))
    return row.withColumn("shift", F.col("treated") - F.col("now"))

