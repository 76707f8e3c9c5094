"""Robust local trend (lowess).

The trend is fitted at anchors: the values at even ranks of x, or all values if they are few. Each
anchor has the window of its nearest share of the rows, found exactly: with running counts over the
distinct values, every value knows where the window that begins there ends, and an anchor's window
is the one whose farther end is nearest. A fit is one aggregate over rows and anchors, partial in
each task. Between anchors the trend is a straight line. Each further round weighs rows down by
their residual beside six times the exact median of all absolute residuals (bisquare).
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.scalars import digitize
from tabulon.plans.ordered import running
from tabulon.plans.quantiles import quantile_table
from tabulon.plans.shared import cut

ANCHORS, SHARE, ROUNDS = 50, 0.3, 2


def _anchors_and_widths(rows: DataFrame, anchors: int, share: float, group_rows: int | None) -> tuple[list[float], list[float]]:
    """Places of the fits, ascending, and the half-width of the window of each."""
    counts = cut(running(rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")), [], ["_x"], {"_upto": ("sum", "_n")}, group_rows))
    total, distinct = counts.agg(F.max("_upto"), F.count(F.lit(1))).first()
    if not total:
        return [], []
    if distinct <= anchors:
        places = [r[0] for r in counts.select("_x").collect()]
    else:
        ranks = sorted({1 + round(g * (total - 1) / (anchors - 1)) for g in range(anchors)})
        wanted = F.array(*[F.lit(r) for r in ranks])
        holds = F.exists(wanted, lambda r: (r > F.col("_upto") - F.col("_n")) & (r <= F.col("_upto")))
        places = [r[0] for r in counts.filter(holds).select("_x").collect()]
    places = sorted(places)
    near = min(total, max(1, math.ceil(share * total)))
    # The window that begins at a value ends at the first value with `near` more rows up to it: the least
    # value of those places in the order of ranks that lie no earlier.
    begin = counts.select(F.col("_x").alias("_from"), (F.col("_upto") - F.col("_n") + near).alias("_at"), F.lit(None).cast("double").alias("_v"))
    marks = counts.select(F.lit(None).cast("double").alias("_from"), F.col("_upto").alias("_at"), F.col("_x").alias("_v"))
    both = running(begin.unionByName(marks), [], [F.col("_at").desc(), F.col("_v").desc_nulls_last(), "_from"], {"_to": ("min", "_v")}, group_rows)
    windows = both.filter(F.col("_from").isNotNull() & F.col("_to").isNotNull())
    reach = [F.min(F.greatest(F.lit(p) - F.col("_from"), F.col("_to") - F.lit(p))).alias(f"h{k}") for k, p in enumerate(places)]
    return places, [float(h) for h in windows.agg(*reach).first()]


def _local_sums(places: list[float], widths: list[float]):
    """Weighted sums of a task's rows (x, y, w) around every anchor, as rows (k, s0, s1, s2, t0, t1)."""
    names = ["s0", "s1", "s2", "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(places), len(names)))
        for batch in batches:
            x, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k, (at, h) in enumerate(zip(places, widths)):
                d = x - at
                some = np.flatnonzero((np.abs(d) < h if h > 0 else d == 0) & (w > 0))
                if not len(some):
                    continue
                # Distances beside the width keep the sums of one size.
                z = d[some] / h if h > 0 else np.zeros(len(some))
                near = w[some] * (1 - np.abs(z) ** 3) ** 3
                total[k] += [near.sum(), near @ z, near @ (z * z), near @ y[some], near @ (z * y[some])]
        met = np.flatnonzero(total[:, 0] > 0)
        yield pa.record_batch([pa.array(met, pa.int32()), *[pa.array(total[met, i]) for i in range(len(names))]], ["k", *names])

    return run


def _fit(rows: DataFrame, places: list[float], widths: list[float]) -> list[float]:
    """The local line at each anchor; the weighted mean where the window has no spread."""
    each = rows.select("_x", "_y", F.col("_w").cast("double")).mapInArrow(_local_sums(places, widths), "k int, s0 double, s1 double, s2 double, t0 double, t1 double")
    sums = each.groupBy("k").agg(*[F.sum(c).alias(c) for c in each.columns[1:]])
    out = [float("nan")] * len(places)
    for r in sums.collect():
        det = r["s0"] * r["s2"] - r["s1"] * r["s1"]
        flat = det <= 1e-12 * r["s0"] * max(r["s2"], 1e-300)
        out[r["k"]] = r["t0"] / r["s0"] if flat else (r["s2"] * r["t0"] - r["s1"] * r["t1"]) / det
    return _filled(places, out)


def _filled(places: list[float], values: list[float]) -> list[float]:
    """An anchor whose rows all lost their weight takes the line between its neighbours."""
    known = [k for k, v in enumerate(values) if not math.isnan(v)]
    return [float(v) for v in np.interp(places, [places[k] for k in known], [values[k] for k in known])]


def line_through(x: Column, places: list[float], values: list[float]) -> Column:
    """Straight lines between the places; beyond them the first and last go on."""
    if len(places) == 1:
        return F.lit(values[0])
    spots = [F.array(*[F.lit(v) for v in some]) for some in (places, values)]
    i = digitize(x, places)
    x0, x1, y0, y1 = (F.get(a, i - 1 + k) for a in spots for k in (0, 1))
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def lowess(
    df: DataFrame, x: str, y: str, share: float = SHARE, rounds: int = ROUNDS, anchors: int = ANCHORS, group_rows: int | None = None
) -> DataFrame:
    """x, trend, width: the robust local trend of y on x at its anchors, ascending.

    ``share`` of the rows is in each window (at least one); ``rounds`` of robust weights follow the
    first fit, none if 0. Rows that miss x or y take no part. Only anchors reach the driver.
    """
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    rows = cut(rows.filter(~F.isnan("_x") & ~F.isnan("_y")))
    schema = "x double, trend double, width double"
    places, widths = _anchors_and_widths(rows, anchors, share, group_rows)
    if not places:
        return df.sparkSession.createDataFrame([], schema)
    weighted, trend = rows.withColumn("_w", F.lit(1.0)), []
    for k in range(rounds + 1):
        trend = _fit(weighted, places, widths)
        if k == rounds:
            break
        residual = F.abs(F.col("_y") - line_through(F.col("_x"), places, trend))
        scale = quantile_table(rows.withColumn("_r", residual), ["_r"], [0.5]).first()["value"]
        if not scale:
            break
        u = residual / F.lit(6.0 * scale)
        weighted = rows.withColumn("_w", F.when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0))
    return df.sparkSession.createDataFrame(list(zip(places, trend, widths)), schema)
