"""What boosted trees are made of: contributions of single features to single predictions.

A tree's expectation given some of a row's features follows the row at their splits and goes both
ways, by the share of training rows, at the others. The Shapley value of that game has a closed
form on each path: with o = 1 where the row meets all of a feature's conditions and w the share of
rows that go the path's way at its splits, feature j of a leaf of value v has

    v (o_j - w_j) * integral over t in 0..1 of prod over i != j of (w_i (1 - t) + o_i t)

and the integrand is a polynomial of a degree below the path's features, which Gauss-Legendre
points integrate without error. So every tree is arithmetic on a few columns, batch by batch.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Node:
    """A split (feature, whether a row goes left) or a leaf (value and number in its tree), and its training rows."""

    value: float = 0.0
    feature: int = -1
    left: "Node | None" = None
    right: "Node | None" = None
    threshold: float = 0.0
    categories: list[float] = field(default_factory=list)
    number: int = -1
    rows: int = 0

    def goes_left(self, x: Column) -> Column:
        return x.isin(self.categories) if self.categories else x <= F.lit(self.threshold)

    def leaves(self) -> list["Node"]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def count(self, by_leaf: dict[int, int]) -> int:
        self.rows = by_leaf.get(self.number, 0) if self.left is None else self.left.count(by_leaf) + self.right.count(by_leaf)
        return self.rows

    def mean(self) -> float:
        """Value of a row about which nothing is known."""
        if self.left is None:
            return self.value
        p = self.share(True)
        return p * self.left.mean() + (1 - p) * self.right.mean()

    def share(self, left: bool) -> float:
        """Of the rows here, those that go one way; half where there are none."""
        p = self.left.rows / self.rows if self.rows else 0.5
        return p if left else 1 - p


def read_trees(model) -> list[tuple[float, Node]]:
    """Weight and root of every tree of a fitted tree model, without counts of rows."""

    def node(j) -> Node:
        if not j.getClass().getSimpleName().startswith("Internal"):
            return Node(value=float(j.prediction()))
        split = j.split()
        at = Node(feature=split.featureIndex(), left=node(j.leftChild()), right=node(j.rightChild()))
        if split.getClass().getSimpleName().startswith("Categorical"):
            at.categories = [float(c) for c in split.leftCategories()]
        else:
            at.threshold = float(split.threshold())
        return at

    trees = getattr(model, "trees", [model])
    weights = getattr(model, "treeWeights", [1.0])
    out = []
    for w, t in zip(weights, trees):
        root = node(t._java_obj.rootNode())
        for number, leaf in enumerate(root.leaves()):
            leaf.number = number
        out.append((float(w), root))
    return out


def _leaf_number(at: Node, xs: Sequence[Column]) -> Column:
    if at.left is None:
        return F.lit(at.number)
    return F.when(at.goes_left(xs[at.feature]), _leaf_number(at.left, xs)).otherwise(_leaf_number(at.right, xs))


def counted_trees(model, background: DataFrame, xs: Sequence[str]) -> list[tuple[float, Node]]:
    """The trees with the background's rows in every node, from one pass that sends back a number per leaf."""
    trees = read_trees(model)
    numbers = F.array(*[_leaf_number(root, [F.col(x).cast("double") for x in xs]) for _, root in trees])
    counts = background.dropna(subset=list(xs)).select(F.posexplode(numbers).alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    for k, (_, root) in enumerate(trees):
        root.count({r["leaf"]: r["count"] for r in counts if r["tree"] == k})
    return trees


def _paths(root: Node) -> list[tuple[float, dict[int, tuple[list[tuple[Node, bool]], float]]]]:
    """Per leaf its value and, per feature on its path, the conditions and the share of rows that meet them all."""
    out = []

    def walk(at: Node, seen: dict[int, tuple[list[tuple[Node, bool]], float]]) -> None:
        if at.left is None:
            out.append((at.value, seen))
            return
        for child, left in ((at.left, True), (at.right, False)):
            conditions, share = seen.get(at.feature, ([], 1.0))
            walk(child, {**seen, at.feature: ([*conditions, (at, left)], share * at.share(left))})

    walk(root, {})
    return out


def _tree_effects(weight: float, root: Node, xs: Sequence[np.ndarray], out: np.ndarray) -> None:
    """Add the Shapley values of one tree to ``out``, a row per feature, for a batch of rows."""
    sides: dict[int, np.ndarray] = {}

    def met_all(conditions: list[tuple[Node, bool]], f: int) -> np.ndarray:
        for at, _ in conditions:
            if id(at) not in sides:
                sides[id(at)] = np.isin(xs[f], at.categories) if at.categories else xs[f] <= at.threshold
        return np.logical_and.reduce([sides[id(at)] if left else ~sides[id(at)] for at, left in conditions])

    for value, parts in _paths(root):
        if not parts:
            continue
        met = {f: met_all(conditions, f) for f, (conditions, _) in parts.items()}
        points, weights = np.polynomial.legendre.leggauss((len(parts) + 1) // 2)
        # From -1..1 to 0..1. Each factor takes one of two values, by whether the row meets the conditions.
        points, weights = (points + 1) / 2, weights / 2
        for j, (_, w_j) in parts.items():
            integral = np.zeros(out.shape[1])
            for t, c in zip(points, weights):
                term = np.full(out.shape[1], c * value * weight)
                for i, (_, w) in parts.items():
                    if i != j:
                        term *= np.where(met[i], w * (1 - t) + t, w * (1 - t))
                integral += term
            out[j] += np.where(met[j], 1 - w_j, -w_j) * integral


def _effects(trees: list[tuple[float, Node]], k: int):
    """Effects of the features, as an array. A task works on whole batches: as one expression the trees outgrow compiled code."""

    @F.pandas_udf("array<double>")
    def effects(features: pd.DataFrame) -> pd.Series:
        xs = [features.iloc[:, j].to_numpy(float) for j in range(k)]
        out = np.zeros((k, len(features)))
        for w, root in trees:
            _tree_effects(w, root, xs, out)
        return pd.Series(list(out.T.copy()), index=features.index)

    return effects


def tree_contributions(model, df: DataFrame, xs: Sequence[str], background: DataFrame) -> DataFrame:
    """Exact per-row contributions of a tree model as ``<x>_effect``, and the ``base`` that they start from.

    Shapley values over all features, those left out being spread as the rows of ``background``
    (the training rows, as a rule) spread in each tree. Base and effects add up to the prediction.
    Rows that miss a feature have NULL effects, as they have no prediction.
    """
    trees = counted_trees(model, background, xs)
    cols = [F.col(f"`{x}`").cast("double") for x in xs]
    known = reduce(and_, [c.isNotNull() for c in cols])
    whole = df.withColumn("_effects", _effects(trees, len(xs))(F.struct(*[c.alias(f"x{j}") for j, c in enumerate(cols)])))
    out = {"base": F.lit(float(sum(w * root.mean() for w, root in trees)))}
    out |= {f"{x}_effect": F.when(known, F.get("_effects", F.lit(j))) for j, x in enumerate(xs)}
    return whole.withColumns(out).drop("_effects")
