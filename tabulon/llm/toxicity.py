"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each link is a logistic model on words and word
stems, and on the log odds of the links before it. A link is trained on what earlier links said
of rows they had not seen (out-of-fold), so at prediction it may trust them as far as in training.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.shared import fresh, small_batches, stored, text_of

# At most so many labelled documents are fitted on: those whose ids have the smallest hashes.
LABELLED = 20_000
# Features: seen in so many labelled documents, this far from chance for some category, at most so many.
LEAST_DOCS, LEAST_Z, FEATURES = 4, 5.0, 20_000
STEM = 5
FOLDS = 4
RIDGE = 1.0
# Log odds handed on by a link lie within this bound.
ODDS = 6.0
_WORD = re.compile(r"[^\W_]+")
LONG_TEXT = 4_000_000


def features(text: str) -> set[str]:
    """Distinct words, and the first letters of longer ones, marked by a star."""
    text = text.lower()
    words = set(_WORD.findall(text)) if len(text) <= LONG_TEXT else {m.group() for m in _WORD.finditer(text)}
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Labelled rows as positions of the features they have, row after row."""

    at: np.ndarray
    size: np.ndarray
    width: int

    def take(self, rows: np.ndarray) -> "Rows":
        return Rows(self.at[np.repeat(rows, self.size)], self.size[rows], self.width)

    def only(self, columns: np.ndarray) -> "Rows":
        kept, owner = columns[self.at], np.repeat(np.arange(len(self.size)), self.size)
        return Rows(self.at[kept], np.bincount(owner[kept], minlength=len(self.size)), self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(owner, weights=w[self.at], minlength=len(self.size))

    def dot_rows(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=np.repeat(r, self.size), minlength=self.width)


@dataclass
class Link:
    bias: float
    weights: np.ndarray
    earlier: np.ndarray

    def odds(self, own: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.bias + own + earlier @ self.earlier


def minimise(value_and_slope, start: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a halving line search, for a smooth convex function."""
    x, (f, g) = start, value_and_slope(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            back.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, size = g @ d, 1.0
        while size > 1e-8:
            nx = x + size * d
            nf, ng = value_and_slope(nx)
            if nf <= f + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        if (ng - g) @ (nx - x) > 1e-12:
            past = [*past[-memory + 1 :], (nx - x, ng - g)]
        done = f - nf <= 1e-7 * abs(f)
        x, f, g = nx, nf, ng
        if done:
            break
    return x


def fit_link(x: Rows, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression with a ridge penalty on all weights but the bias."""
    n, k = earlier.shape
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 1e-3
    bias = float(np.log(rate / (1 - rate)))
    if not n or y.min() == y.max():
        return Link(bias, np.zeros(x.width), np.zeros(k))
    penalty = np.append(np.full(x.width + k, RIDGE), 0.0)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        odds = x.dot(p[: x.width]) + earlier @ p[x.width : -1] + p[-1]
        r = _sigmoid(odds) - y
        slope = np.concatenate([x.dot_rows(r), earlier.T @ r, [r.sum()]]) + penalty * p
        return float(np.logaddexp(0, odds).sum() - y @ odds + 0.5 * (penalty * p * p).sum()), slope

    p = minimise(loss, np.append(np.zeros(x.width + k), bias))
    return Link(float(p[-1]), p[: x.width], p[x.width : -1])


@dataclass
class Chain:
    """A fitted chain: names of the categories, features by place, one link and threshold each."""

    names: list[str]
    place: dict[str, int]
    links: list[Link]
    thresholds: list[float]

    def probabilities(self, text: str) -> list[float]:
        own = [i for f in features(text) if (i := self.place.get(f)) is not None]
        odds: list[float] = []
        for link in self.links:
            o = link.bias + float(link.weights[own].sum()) + float(np.dot(link.earlier, odds))
            odds.append(float(np.clip(o, -ODDS, ODDS)))
        return [float(_sigmoid(o)) for o in odds]


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Log odds with the best F1 out of fold; the middle of the gap they lie in."""
    if not y.any() or y.all():
        return 0.0
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + y.sum())
    last = np.append(odds[order][1:] != odds[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((odds[order][k] + odds[order][min(k + 1, len(order) - 1)]) / 2)


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
    labelled: int = LABELLED,
) -> Chain:
    """Fit one link per category, in the order given; ``categories`` maps names to 0/1 columns of ``labels``.

    Documents are joined to labels by ``id_col``. At most ``labelled`` ids are used, those with the
    smallest hash of their id, so the sample is bounded and does not depend on partitions. An id
    labelled twice has a category if one of its labels has it; labels with a null are left out.
    """
    small_batches(docs.sparkSession)
    names = list(categories)
    given = labels.select(F.col(id_col).alias("id"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    given = given.dropna().groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    given = stored(given.orderBy(F.xxhash64("id"), "id").limit(labelled), "labels")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features(t)))

    # At most ``labelled`` rows are broadcast, so the texts stay where they are.
    rows = texts.join(F.broadcast(given), "id").withColumn("words", F.pandas_udf(words, "array<string>")("text")).drop("text")
    rows = stored(rows, "labelled", compact=True)
    ys = [f"y{i}" for i in range(len(names))]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = total["n"]
    counts = rows.select("id", F.explode("words").alias("word"), *ys).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])

    def surprise(y: str) -> Column:
        rate = (total[y] or 0.0) / n if n else 0.0
        if not 0 < rate < 1:
            return F.lit(0.0)
        return F.abs(F.col(y) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))

    scored = counts.filter(F.col("n") >= LEAST_DOCS).select("word", F.array(*map(surprise, ys)).alias("z"))
    scored = scored.withColumn("most", F.array_max("z")).filter(F.col("most") >= LEAST_Z)
    chosen = scored.orderBy(F.col("most").desc(), "word").limit(FEATURES).collect()
    place = {r["word"]: i for i, r in enumerate(chosen)}
    # A link sees the features that tell something about its own category.
    telling = np.array([r["z"] for r in chosen]).reshape(-1, len(ys)) >= LEAST_Z
    shipped = rows.sparkSession.sparkContext.broadcast(place)

    def places(series: pd.Series) -> pd.Series:
        return series.map(lambda ws: [i for w in ws if (i := shipped.value.get(w)) is not None])

    fold = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FOLDS)).alias("fold")
    table = rows.select("id", fold, *ys, F.pandas_udf(places, "array<int>")("words").alias("at")).orderBy("id").toPandas()
    size = table["at"].map(len).to_numpy(dtype=np.int64)
    at = np.concatenate([*table["at"], np.empty(0)]).astype(np.int64)
    every, fold = Rows(at, size, len(place)), table["fold"].to_numpy()
    earlier, links, thresholds = np.empty((len(table), 0)), [], []
    for k, y in enumerate(ys):
        truth, x = table[y].to_numpy(dtype=float), every.only(telling[:, k])
        odds = np.zeros(len(table))
        for f in range(FOLDS):
            seen, held = fold != f, fold == f
            if held.any():
                link = fit_link(x.take(seen), earlier[seen], truth[seen])
                odds[held] = link.odds(x.take(held).dot(link.weights), earlier[held])
        odds = np.clip(odds, -ODDS, ODDS)
        links.append(fit_link(x, earlier, truth))
        thresholds.append(float(_sigmoid(best_threshold(odds, truth > 0))))
        earlier = np.column_stack([earlier, odds])
    return Chain(names, place, links, thresholds)


def _score(docs: DataFrame, chain: Chain, text_col: str) -> Column:
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [f"p_{n}" for n in chain.names]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for texts in batches:
            yield pd.DataFrame([model.probabilities(t) for t in texts], columns=fields, dtype="float64")

    kind = ", ".join(f"`{f}` double" for f in fields)
    return F.pandas_udf(score, kind)(text_of(text_col))


def score_toxicity(docs: DataFrame, chain: Chain, reject: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, a probability per category (p_name), and ``rejected``.

    A row is rejected if the probability of ``reject`` reaches that category's threshold. Whole
    texts are read; null and empty texts have no features and get the base rate; null or repeated
    ids are passed on; other columns are not read; an empty table gives no rows. Without labels
    nothing is rejected.
    """
    scored = docs.select(F.col(id_col), _score(docs, chain, text_col).alias("_p")).select(id_col, "_p.*")
    return scored.withColumn("rejected", F.col(f"p_{reject}") >= F.lit(chain.thresholds[chain.names.index(reject)]))


def drop_toxic(docs: DataFrame, chain: Chain, reject: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; no row moves."""
    name = fresh(docs, "scores")
    limit = chain.thresholds[chain.names.index(reject)]
    return docs.withColumn(name, _score(docs, chain, text_col)).filter(F.col(f"{name}.p_{reject}") < F.lit(limit)).drop(name)


def label_categories() -> dict[str, Column]:
    """The categories that the labels table gives, broad ones first."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_and_low": low & toxic}
