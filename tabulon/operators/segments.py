"""Segments grown from data: where the effect of a treatment differs.

On residuals of outcome and treatment the effect of a set of rows is sum(rt*ry) / sum(rt*rt), and
the squared error it leaves falls by sum(rt*ry)^2 / sum(rt*rt). A tree is grown level by level: one
pass sums both moments per node, feature and bin, and running sums over the bins give every split's
gain at once. Rows of one half choose the splits and those of the other give the effects, so a
segment's effect owes nothing to its having been chosen.
"""

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.causal import residual_pairs, slope
from tabulon.operators.rows import uniform
from tabulon.plans.gram import Terms
from tabulon.plans.quantiles import quantile_edges
from tabulon.plans.sizes import small_rows

BINS, LEAST_ROWS = 32, 50


@dataclass
class Split:
    """A node's rows with feature <= threshold go to 2 * node, the others to 2 * node + 1."""

    node: int
    feature: str
    threshold: float
    gain: float


def cut_points(df: DataFrame, feature: str, bins: int) -> list[float]:
    """Where a feature may be split: between its values if they are few, else at its quantiles."""
    values = [r[0] for r in df.select(F.col(feature).cast("double")).dropna().distinct().limit(bins + 1).collect()]
    edges = sorted(values) if len(values) <= bins else sorted(set(quantile_edges(df, feature, bins)[1:]))
    return edges[:-1]


def _bin(feature: str, cuts: Sequence[float]) -> Column:
    """Number of cut points that lie below the value."""
    x = F.col(feature).cast("double")
    return reduce(lambda a, b: a + b, [(x > F.lit(c)).cast("int") for c in cuts], F.lit(0))


def grow(pairs: DataFrame, features: Sequence[str], depth: int, bins: int = BINS, least_rows: int = LEAST_ROWS) -> list[Split]:
    """Splits of the residual pairs (_ry, _rt), level by level; of equal gains the first feature's lowest one.

    A level is one aggregate: at most 2^level * features * (bins + 1) rows come back.
    """
    cuts = {f: cut_points(pairs, f, bins) for f in features}
    cuts = {f: c for f, c in cuts.items() if c}
    if not cuts:
        return []
    complete = pairs.dropna(subset=["_ry", "_rt", *cuts])
    moment = [(F.col("_rt") * F.col("_ry")).alias("ty"), (F.col("_rt") * F.col("_rt")).alias("tt")]
    cells = F.array(*[F.struct(F.lit(k).alias("f"), _bin(f, c).alias("b")) for k, (f, c) in enumerate(cuts.items())])
    names, splits = list(cuts), []
    open_nodes = {1}
    for _ in range(depth):
        at = complete.select(node_of(splits).alias("node"), *moment, F.explode(cells).alias("cell"))
        sums = at.filter(F.col("node").isin(sorted(open_nodes))).groupBy("node", "cell").agg(F.sum("ty").alias("ty"), F.sum("tt").alias("tt"), F.count("*").alias("n"))
        by_node = defaultdict(lambda: defaultdict(dict))
        for r in small_rows(sums, len(open_nodes) * len(names) * (bins + 1)):
            by_node[r["node"]][r["cell"]["f"]][r["cell"]["b"]] = (r["ty"], r["tt"], r["n"])
        new = [best for node in sorted(by_node) if (best := _best(node, by_node[node], names, cuts, least_rows))]
        splits += new
        open_nodes = {child for s in new for child in (2 * s.node, 2 * s.node + 1)}
        if not new:
            break
    return splits


def _fall(ty: float, tt: float) -> float:
    return ty * ty / tt if tt > 0 else 0.0


def _best(node: int, cells: dict, names: list[str], cuts: dict[str, list[float]], least_rows: int) -> Split | None:
    best = None
    for f, bins in sorted(cells.items()):
        ty, tt, n = (sum(c[k] for c in bins.values()) for k in range(3))
        left = [0.0, 0.0, 0]
        for b, cut in enumerate(cuts[names[f]]):
            left = [a + c for a, c in zip(left, bins.get(b, (0.0, 0.0, 0)))]
            if min(left[2], n - left[2]) < least_rows:
                continue
            gain = _fall(left[0], left[1]) + _fall(ty - left[0], tt - left[1]) - _fall(ty, tt)
            if gain > 0 and (best is None or gain > best.gain):
                best = Split(node, names[f], cut, gain)
    return best


def node_of(splits: Sequence[Split]) -> Column:
    """Number of the leaf that a row falls into: 1 for all rows, then 2n and 2n + 1. A missing value goes right."""
    by_node = {s.node: s for s in splits}

    def at(node: int) -> Column:
        s = by_node.get(node)
        if s is None:
            return F.lit(node)
        return F.when(F.col(s.feature).cast("double") <= F.lit(s.threshold), at(2 * node)).otherwise(at(2 * node + 1))

    return at(1)


def rule_of(splits: Sequence[Split], node: int) -> str:
    """The conditions that lead to a node, in words."""
    by_node, parts = {s.node: s for s in splits}, []
    while node > 1:
        s = by_node[node // 2]
        parts.append(f"{s.feature} {'>' if node % 2 else '<='} {s.threshold:g}")
        node //= 2
    return " and ".join(reversed(parts)) or "all"


def grown_segments(
    df: DataFrame, y: str, t: str, xs: Terms, features: Sequence[str], depth: int, folds: int, seed: int, key: Sequence[str],
    bins: int = BINS, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Effect of the treatment per grown segment: node, rule, effect, se, p, low, high, n.

    Controls are partialled out across folds; rows whose hash with ``seed + 1`` is below one half
    grow the tree, the others estimate.
    """
    pairs = residual_pairs(df, y, t, xs, folds, seed, key)
    half = uniform(key, seed + 1) < 0.5
    splits = grow(pairs.filter(half), features, depth, bins, least_rows)
    honest = pairs.filter(~half).withColumn("node", node_of(splits))
    rules = {n: rule_of(splits, n) for n in _leaves(splits)}
    named = F.create_map(*[F.lit(v) for n, r in rules.items() for v in (n, r)])
    return slope(honest, ["node"]).withColumn("rule", named[F.col("node")])


def _leaves(splits: Sequence[Split]) -> list[int]:
    inner = {s.node for s in splits}
    reached = {1} | {c for n in inner for c in (2 * n, 2 * n + 1)}
    return sorted(reached - inner)
