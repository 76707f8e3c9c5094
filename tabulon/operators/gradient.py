"""Models that learn from mistakes and gradients: passes over rows in tasks, small weights between them."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.rows import uniform
from tabulon.plans.shared import cut

# Rows whose margins are looked at together.
BLOCK = 256


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summed(parts: DataFrame, weight: str | None = None) -> dict[int, float]:
    """Arrays (column v) of all tasks added up place by place, each times its weight."""
    value = F.col("x") * F.col(weight) if weight else F.col("x")
    each = parts.select(*([weight] if weight else []), F.posexplode("v").alias("i", "x"))
    return {r["i"]: r["s"] for r in each.groupBy("i").agg(F.sum(value).alias("s")).collect()}


# Perceptron


@dataclass
class Separator:
    """Weights and constant of a plane, the passes it took, and whether the last of them made no mistake."""

    weights: np.ndarray
    constant: float
    rounds: int
    separates: bool

    def side(self, xs: Sequence[str]) -> Column:
        """+1 or -1; a point on the plane counts as -1."""
        score = F.lit(self.constant)
        for x, w in zip(xs, self.weights):
            score = score + F.lit(float(w)) * F.col(x).cast("double")
        return F.when(score > 0, 1).when(score <= 0, -1)


def one_pass(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """The perceptron's updates over rows in their order (x with a last column of ones), and how many there were."""
    w, mistakes = w.copy(), 0
    for start in range(0, len(x), BLOCK):
        xs, ys, at = x[start : start + BLOCK], y[start : start + BLOCK], 0
        while at < len(xs):
            wrong = np.flatnonzero(ys[at:] * (xs[at:] * w).sum(axis=1) <= 0)
            if not len(wrong):
                break
            at += int(wrong[0])
            w += ys[at] * xs[at]
            mistakes, at = mistakes + 1, at + 1
    return w, mistakes


def fit_perceptron(df: DataFrame, y: str, xs: Sequence[str], rounds: int = 50) -> Separator:
    """Mistake-driven linear separator of labels above 0 and others, by iterative parameter mixing.

    In each round every task passes once over its rows from the same weights, updating them at each
    mistake; the tasks' weights are averaged by their rows. A round without a mistake ends the fit:
    its weights separate all rows. Tables that no plane separates run all ``rounds``. Rows that miss
    a value take no part.
    """
    k = len(xs) + 1
    x = F.array(*[F.col(c).cast("double") for c in xs], F.lit(1.0))
    side = F.when(F.col(y) > 0, 1.0).when(F.col(y) <= 0, -1.0)
    data = cut(df.select(x.alias("x"), side.alias("y")).filter(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull()))
    w = np.zeros(k)
    for done in range(1, rounds + 1):
        start = w

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            now, mistakes, n = start, 0, 0
            for b in batches:
                now, wrong = one_pass(now, _matrix(b.column(0), k), b.column(1).to_numpy())
                mistakes, n = mistakes + wrong, n + b.num_rows
            if n:
                yield pa.record_batch([pa.array([now.tolist()]), pa.array([float(n)]), pa.array([float(mistakes)])], ["v", "n", "mistakes"])

        parts = data.mapInArrow(run, "v array<double>, n double, mistakes double")
        # Rows and mistakes travel behind the weights, so that one sum brings all.
        both = F.concat(F.transform("v", lambda v: v * F.col("n")), F.array("n", "mistakes"))
        sums = _summed(parts.select(both.alias("v")))
        if not sums:
            return Separator(w[:-1], float(w[-1]), done, True)
        if sums[k + 1] == 0:
            return Separator(w[:-1], float(w[-1]), done, True)
        w = np.array([sums[i] / sums[k] for i in range(k)])
    return Separator(w[:-1], float(w[-1]), rounds, False)


# Layers with rectified hidden units


@dataclass
class Layers:
    """Weights (inputs x outputs) and constants of each layer; hidden units pass what is above zero."""

    weights: list[np.ndarray]
    constants: list[np.ndarray]

    @classmethod
    def start(cls, sizes: Sequence[int], seed: int) -> "Layers":
        rng = np.random.default_rng(seed)
        return cls([rng.normal(size=(a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for pair in zip(self.weights, self.constants) for v in pair])

    def like(self, flat: np.ndarray) -> "Layers":
        out, at = Layers([], []), 0
        for w, c in zip(self.weights, self.constants):
            out.weights.append(flat[at : at + w.size].reshape(w.shape))
            out.constants.append(flat[at + w.size : at + w.size + c.size])
            at += w.size + c.size
        return out

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs of every layer, and log probabilities of the classes."""
        inputs = [x]
        for w, c in zip(self.weights[:-1], self.constants[:-1]):
            inputs.append(np.maximum(inputs[-1] @ w + c, 0.0))
        z = inputs[-1] @ self.weights[-1] + self.constants[-1]
        z = z - z.max(axis=1, keepdims=True)
        return inputs, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradient(self, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum over rows of the cross-entropy, and its derivatives in the order of ``flat``."""
        inputs, log_p = self.forward(x)
        rows = np.arange(len(x))
        loss, delta = -log_p[rows, label].sum(), np.exp(log_p)
        delta[rows, label] -= 1
        parts: list[np.ndarray] = []
        for i in reversed(range(len(self.weights))):
            parts = [(inputs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
            if i:
                delta = (delta @ self.weights[i].T) * (inputs[i] > 0)
        return float(loss), np.concatenate(parts)


@dataclass
class Trained:
    model: Layers
    losses: list[float]

    def predict(self, df: DataFrame, vec: str) -> DataFrame:
        """Rows with ``probability`` (an array) and ``prediction``; rows without a whole vector have neither."""
        model, width = self.model, len(self.model.weights[0])

        @F.pandas_udf("array<double>")
        def probability(vectors):
            x = np.array(vectors.tolist(), float).reshape(len(vectors), width)
            return vectors.__class__(list(np.exp(model.forward(x)[1])), index=vectors.index)

        v = F.col(vec).cast("array<double>")
        whole = (F.size(v) == width) & F.forall(v, lambda c: c.isNotNull())
        p = F.when(whole, probability(F.when(whole, v).otherwise(F.array_repeat(F.lit(0.0), width))))
        best = F.array_position(F.col("probability"), F.array_max("probability")) - 1
        return df.withColumn("probability", p).withColumn("prediction", best.cast("int"))


def fit_layers(
    df: DataFrame, label: str, vec: str, sizes: Sequence[int], key: Sequence[str], steps: int = 60, batch: float = 1.0, rate: float = 0.01, seed: int = 1
) -> Trained:
    """Perceptron layers with rectified hidden units and a softmax, by distributed mini-batch gradients.

    ``sizes`` are the inputs, hidden units and classes; labels run from 0. A step takes the share
    ``batch`` of the rows, by hash of their key and the step; tasks add up the gradients of their
    rows and Spark adds up the tasks'. The driver holds the weights and moves them (Adam). Rows
    that miss the label or part of the vector take no part.
    """
    v = F.col(vec).cast("array<double>")
    data = df.select(*key, v.alias("_v"), F.col(label).cast("int").alias("_label"))
    data = cut(data.filter((F.size("_v") == sizes[0]) & F.forall("_v", lambda c: c.isNotNull()) & F.col("_label").between(0, sizes[-1] - 1)))
    model = Layers.start(sizes, seed)
    at, first, second, losses = model.flat(), 0.0, 0.0, []
    for step in range(1, steps + 1):
        now = model.like(at)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(at) + 2)
            for b in batches:
                if b.num_rows:
                    loss, slope = now.gradient(_matrix(b.column(0), sizes[0]), b.column(1).to_numpy())
                    total += np.concatenate([slope, [loss, b.num_rows]])
            if total[-1]:
                yield pa.record_batch([pa.array([total.tolist()])], ["v"])

        some = data if batch >= 1 else data.filter(uniform(key, seed * 100_003 + step) < batch)
        sums = _summed(some.select("_v", "_label").mapInArrow(run, "v array<double>"))
        if not sums:
            continue
        total = np.array([sums[i] for i in range(len(at) + 2)])
        losses.append(float(total[-2] / total[-1]))
        slope = total[:-2] / total[-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Trained(model.like(at), losses)
