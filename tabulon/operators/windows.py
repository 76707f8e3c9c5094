"""Per-row figures that depend on a group or on neighbouring rows.

Group figures are aggregated first and joined back. Ordered figures use a plain window while each
group fits one task, and positions plus blocks beyond that (see ``plans.ordered``).
"""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tabulon.operators.relational import backfill
from tabulon.plans import ordered
from tabulon.plans.ordered import Order, neighbours, running, with_position
from tabulon.plans.shared import cut
from tabulon.plans.sizes import join_groups, with_scalars

# A weight below this cannot change a double.
NEGLIGIBLE = 1e-20


def group_total(df: DataFrame, by: Sequence[str], c: str, share: bool = True) -> DataFrame:
    """Group total on every row and the row's share of it."""
    out = join_groups(df, df.groupBy(*by).agg(F.sum(c).alias("total")), by)
    return out.withColumn("share", F.try_divide(F.col(c).cast("double"), F.col("total").cast("double"))) if share else out


def group_mean(df: DataFrame, by: Sequence[str], c: str, name: str = "mean") -> DataFrame:
    return join_groups(df, df.groupBy(*by).agg(F.avg(c).alias(name)), by)


def demean(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Subtract the group mean from each column."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = join_groups(df, means, by)
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def dense_rank(
    df: DataFrame, by: Sequence[str], c: str, name: str = "dense_rank", group_rows: int | None = None
) -> DataFrame:
    """Dense rank by descending value: the position among the distinct values of the group."""
    values = df.select(*by, c).distinct()
    ranked = with_position(values, by, [F.col(c).desc()], name, group_rows)
    return join_groups(df, ranked, [*by, c])


def avg_rank(
    df: DataFrame, by: Sequence[str], c: str, name: str = "avg_rank", group_rows: int | None = None
) -> DataFrame:
    """Descending rank in which ties share the mean of their places."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_n"))
    upto = running(counts, by, [F.col(c).desc()], {"_upto": ("sum", "_n")}, group_rows)
    ranks = upto.select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2).cast("double").alias(name))
    return join_groups(df, ranks, [*by, c], "left")


def shift(
    df: DataFrame, c: str, k: int, order: Order, by: Sequence[str] = (), name: str | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Value k rows earlier (k > 0) or later (k < 0)."""
    name = name or f"{c}_{'lag' if k > 0 else 'lead'}{abs(k)}"
    return neighbours(
        df, by, order, lambda w: {name: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)}, max(k, 0), max(-k, 0),
        group_rows,
    )


def rolling(
    df: DataFrame, c: str, width: int, order: Order, by: Sequence[str] = (), fns: Sequence[str] = ("avg",),
    shift: int = 0, group_rows: int | None = None,
) -> DataFrame:
    """Rolling figures over full windows of ``width`` rows that end ``shift`` rows before the row."""
    fn = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}

    def exprs(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(width - 1) - shift, -shift)
        full = F.count(c).over(frame) == width
        return {f"{c}_{f}{width}": F.when(full, fn[f](c).over(frame)) for f in fns}

    return neighbours(df, by, order, exprs, width - 1 + shift, 0, group_rows)


def expanding(
    df: DataFrame, c: str, order: Order, by: Sequence[str] = (), target: str | None = None, group_rows: int | None = None
) -> DataFrame:
    """Running min, mean and max, and optionally the next value as target."""
    out = running(
        df, by, order,
        {"_sum": ("sum", c), "_n": ("count", c), f"{c}_min": ("min", c), f"{c}_max": ("max", c)}, group_rows,
    )
    out = out.withColumn(f"{c}_mean", F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double"))).drop("_sum", "_n")
    return shift(out, c, -1, order, by, target, group_rows) if target else out


def seasonal(
    df: DataFrame, width: int, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """Trend (rolling mean) and season (value minus trend), with the leading gap back-filled."""

    def exprs(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(width - 1), 0)
        out = {}
        for c in cols:
            trend = F.when(F.count(c).over(frame) == width, F.avg(c).over(frame))
            out[f"{c}_trend"], out[f"{c}_season"] = trend, F.col(c) - trend
        return out

    out = neighbours(df, by, order, exprs, width - 1, 0, group_rows)
    return backfill(out, [f"{c}_{s}" for c in cols for s in ("trend", "season")], order, by, group_rows)


def factorize_in_group(
    df: DataFrame, by: Sequence[str], c: str, order: str, name: str = "code", group_rows: int | None = None
) -> DataFrame:
    """Integer codes 0.. within the group by first appearance."""
    first = df.groupBy(*by, c).agg(F.min(order).alias("_first"))
    coded = with_position(first, by, ["_first", c], name, group_rows).withColumn(name, F.col(name) - 1).drop("_first")
    return join_groups(df, coded, [*by, c])


def adstock(
    df: DataFrame, alphas: Mapping[str, float], order: Order, by: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Geometric carry-over y_t = x_t + a * y_(t-1), one output column ``<c>_adstock`` per channel.

    Inside a block of L rows y_t = a^t * sum(a^-s * x_s), a running sum; L keeps a^-L inside the
    range of a double. What a block hands on is a carry-over again, of the block ends and with the
    rate a^L: mostly a^L is far below rounding and one block of carry is exact, otherwise the much
    shorter series of block ends goes through the same function. Rates that can share a block
    length share one window and one join. a = 1 is a plain running sum, a = 0 the series itself.
    """
    if any(not 0 <= a <= 1 for a in alphas.values()):
        raise ValueError("decay rates lie between 0 and 1")
    keep = df.columns
    out = with_position(df, by, order, "_t", group_rows)
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in alphas}
    out = out.withColumns({f"{c}_adstock": x[c] for c, a in alphas.items() if a == 0})
    whole = [c for c, a in alphas.items() if a == 1]
    if whole:
        out = running(out, by, ["_t"], {f"{c}_adstock": ("sum", x[c]) for c in whole}, group_rows)
    groups = _block_lengths({c: a for c, a in alphas.items() if 0 < a < 1})
    for length, rates in groups:
        if len(groups) > 1:
            # Each set of rates reads the table twice; written here, the plan does not double per set.
            out = cut(out)
        t = F.col("_t") - 1
        out = out.withColumn("_b", F.floor(t / F.lit(length))).withColumn("_p", (t % F.lit(length)).cast("double"))
        w = W.partitionBy(*by, "_b").orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
        local = {
            f"_y_{c}": F.sum(x[c] * F.pow(F.lit(a), -F.col("_p"))).over(w) * F.pow(F.lit(a), F.col("_p")) for c, a in rates.items()
        }
        out = out.withColumns(local)
        carry = out.groupBy(*by, "_b").agg(*[F.max_by(f"_y_{c}", "_t").alias(f"_last_{c}") for c in rates])
        slow = {f"_last_{c}": a**length for c, a in rates.items() if a**length > NEGLIGIBLE}
        if slow:
            carry = adstock(cut(carry.withColumnRenamed("_b", "_k")), slow, ["_k"], by)
            carry = carry.drop(*slow).withColumnsRenamed({"_k": "_b", **{f"{n}_adstock": n for n in slow}})
        out = join_groups(out, carry.withColumn("_b", F.col("_b") + 1), [*by, "_b"], "left")
        out = out.withColumns(
            {
                f"{c}_adstock": F.col(f"_y_{c}") + F.coalesce(F.col(f"_last_{c}"), F.lit(0.0)) * F.pow(F.lit(a), F.col("_p") + 1)
                for c, a in rates.items()
            }
        ).drop("_b", "_p", *[f"_{n}_{c}" for n in ("y", "last") for c in rates])
    return out.select(*keep, *[f"{c}_adstock" for c in alphas])


def _block_lengths(alphas: Mapping[str, float]) -> list[tuple[int, dict[str, float]]]:
    """Sets of rates with a common block length, for which a^-L stays below 1e250 and a^L is negligible."""
    groups: list[tuple[int, dict[str, float]]] = []
    for c, a in sorted(alphas.items(), key=lambda x: x[1]):
        if not groups or a ** groups[-1][0] > NEGLIGIBLE:
            groups.append((max(2, min(ordered.BLOCK_ROWS, int(250 / -math.log10(a)))), {}))
        groups[-1][1][c] = a
    return groups


def peaks(df: DataFrame, c: str, order: Order, by: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """Local maxima and minima: rows strictly above, or strictly below, both neighbours."""

    def exprs(w) -> dict[str, Column]:
        before, after, x = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        kind = F.when((x > before) & (x > after), "peak").when((x < before) & (x < after), "valley")
        return {"turn": kind}

    return neighbours(df, by, order, exprs, 1, 1, group_rows).filter("turn is not null")


def sign_changes(df: DataFrame, c: str, order: Order, by: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """Rows after which the direction of the series changes, found by the sign of the differences."""

    def exprs(w) -> dict[str, Column]:
        here = F.signum(F.col(c) - F.lag(c).over(w))
        then = F.signum(F.lead(c).over(w) - F.col(c))
        return {"change": (then - here).cast("double")}

    return neighbours(df, by, order, exprs, 1, 1, group_rows).filter("change <> 0")


def running_rate(
    df: DataFrame, flag: str, order: Order, by: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Running count, running hits and running rate of a 0/1 flag."""
    out = running(df, by, order, {"shown": ("count", F.lit(1)), "hits": ("sum", flag)}, group_rows)
    return out.withColumn("rate", F.col("hits").cast("double") / F.col("shown"))


def topk(df: DataFrame, by: Sequence[str], score: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """Top k rows per group with a deterministic tie order."""
    return ordered.first_per_group(df, by, [F.col(score).desc(), *tie], k)


def with_row_id(df: DataFrame, order: Order, name: str = "row_id", group_rows: int | None = None) -> DataFrame:
    return with_position(df, [], order, name, group_rows)


def acf(df: DataFrame, c: str, lags: int, order: Order, group_rows: int | None = None) -> DataFrame:
    """Autocorrelation up to a lag, with the biased autocovariance (divided by n)."""
    base = with_scalars(df.select(*_names(order), F.col(c).cast("double").alias("_x")), df.agg(F.avg(c).alias("_m")))
    base = base.withColumn("_d", F.col("_x") - F.col("_m"))
    shifted = neighbours(
        base, [], order, lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}, lags, 0, group_rows
    )
    row = shifted.agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_c0"),
        *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    cells = [
        F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"_c{k}"), F.col("_c0")).alias("acf"))
        for k in range(lags + 1)
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _names(order: Order) -> list[str]:
    if not all(isinstance(o, str) for o in order):
        raise TypeError("name the order columns")
    return list(order)


def pacf(df: DataFrame, c: str, lags: int, order: Order, group_rows: int | None = None) -> DataFrame:
    """Partial autocorrelation from the Yule-Walker equations, solved lag by lag on the few ACF values."""
    r = [row["acf"] for row in acf(df, c, lags, order, group_rows).orderBy("lag").collect()]
    out, phi = [(0, 1.0)], []
    for k in range(1, lags + 1):
        num = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        den = 1.0 - sum(p * r[j + 1] for j, p in enumerate(phi))
        last = num / den
        phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
        out.append((k, float(last)))
    return df.sparkSession.createDataFrame(out, "lag long, pacf double")
