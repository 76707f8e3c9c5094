"""Models: Spark ML estimators on assembled columns, and linear searches on additive moments."""

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.scalars import digitize, pct_error
from tabulon.operators.rows import split, split_by_time, uniform
from tabulon.operators.windows import adstock
from tabulon.plans.gram import Fit, as_terms, complete, fit_moments, moments
from tabulon.plans.ordered import Order, neighbours
from tabulon.plans.quantiles import quantile_edges
from tabulon.plans.shared import cut
from tabulon.plans.sizes import GROUP_ROWS, small_rows


def assemble(df: DataFrame, xs: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol=name, handleInvalid="skip").transform(df)


def vector_column(df: DataFrame, c: str, name: str = "features") -> DataFrame:
    """An array column as an ML vector."""
    return df.withColumn(name, array_to_vector(F.col(c).cast("array<double>")))


def fit_linear(df: DataFrame, y: str, xs: Sequence[str], test: float = 0.2, seed: int = 1, key: Sequence[str] = ()):
    """Linear regression on a training part; returns the model and predictions for the test part."""
    parts = split(df, {"train": 1 - test, "test": test}, seed, key or xs)
    data = assemble(parts, xs)
    model = LinearRegression(labelCol=y, solver="normal").fit(data.filter("part = 'train'"))
    return model, model.transform(data.filter("part = 'test'"))


def fit_logistic(df: DataFrame, y: str, xs: Sequence[str], threshold: float = 0.5, iterations: int = 100):
    """Binary logistic regression (a quasi-Newton fit in place of single gradient steps)."""
    data = assemble(df, xs)
    return LogisticRegression(labelCol=y, threshold=threshold, maxIter=iterations, family="binomial").fit(data), data


def fit_softmax(data: DataFrame, y: str, features: str = "features", iterations: int = 50):
    return LogisticRegression(labelCol=y, featuresCol=features, family="multinomial", maxIter=iterations).fit(data)


def fit_separator(df: DataFrame, y: str, xs: Sequence[str], iterations: int = 50):
    """Linear separator of labels -1 and +1: a large-margin fit in place of perceptron updates."""
    data = assemble(df.withColumn("_label", (F.col(y) > 0).cast("int")), xs)
    return LinearSVC(labelCol="_label", maxIter=iterations).fit(data), data


def fit_mlp(data: DataFrame, y: str, layers: Sequence[int], features: str = "features", iterations: int = 60, seed: int = 1):
    """Multi-layer perceptron. Hidden units are sigmoid here, not rectified."""
    return MultilayerPerceptronClassifier(
        labelCol=y, featuresCol=features, layers=list(layers), maxIter=iterations, seed=seed
    ).fit(data)


# Rows of a partition that trees are grown on.
TREE_ROWS = 1_000_000


def fit_gbt(df: DataFrame, y: str, xs: Sequence[str], trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 1, task_rows: int | None = None):
    """Gradient-boosted regression trees on squared loss."""
    data = assemble(df, xs)
    known = data.select(y, "features")
    # The trainer keeps each partition's rows in one piece through all rounds, so a partition has a bounded number.
    tasks = -(-df.count() // (TREE_ROWS if task_rows is None else task_rows))
    if tasks > known.rdd.getNumPartitions():
        known = known.repartition(tasks)
    return GBTRegressor(labelCol=y, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(known), data


def grid_search(
    est, data: DataFrame, grid: Mapping[str, Sequence], y: str, key: Sequence[str], folds: int = 3, seed: int = 1, parallelism: int = 4
) -> DataFrame:
    """Cross-validated error of every parameter combination, best first. Folds go by hash of the row's key."""
    data = data.withColumn("_fold", F.least(F.floor(uniform(key, seed) * folds), F.lit(folds - 1)).cast("int"))
    # Every fold is read many times, so folds are told once, beside those columns that the estimator names.
    named = {est.getOrDefault(p) for p in est.params if p.name.endswith("Col") and est.isDefined(p)} | {y}
    if est.hasParam("featuresCol"):
        data = data.select(*[c for c in data.columns if c in named], "_fold")
    data = cut(data)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    maps = builder.build()
    error = F.sqrt(F.avg(F.pow(F.col(y) - F.col("prediction"), F.lit(2.0))))

    def scores(fold: int) -> list[float]:
        train, rest = data.filter(F.col("_fold") != fold), data.filter(F.col("_fold") == fold)
        if train.isEmpty() or rest.isEmpty():
            raise ValueError(f"no rows to fit or to judge in fold {fold}")
        with ThreadPool(min(parallelism, len(maps))) as pool:
            fits = dict(pool.imap_unordered(lambda at: (at, est.fit(train, maps[at])), range(len(maps))))
            return pool.map(lambda at: fits[at].transform(rest).select(error).first()[0], range(len(maps)))

    means = np.mean([scores(fold) for fold in range(folds)], axis=0)
    rows = [(*[float(m[est.getParam(n)]) for n in grid], float(s)) for m, s in zip(maps, means)]
    schema = ", ".join(f"{n} double" for n in grid) + ", rmse double"
    return data.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[-1]), schema)


def combinations(spark, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every combination of the values of a grid, as a table: the row number, read as a number with one digit per entry."""
    total, out = 1, {}
    for name, values in reversed(grid.items()):
        digit = F.floor(F.col("id") / F.lit(total)) % F.lit(len(values))
        out[name] = F.get(F.array(*[F.lit(float(v)) for v in values]), digit.cast("int"))
        total *= len(values)
    return spark.range(total).select("id", *[out[name].alias(name) for name in grid])


def search_adstock(
    df: DataFrame, y: str, order: Order, grid: Mapping[str, Sequence[float]], controls: Sequence[str], ts: str, t1, t2
) -> DataFrame:
    """Decay rates by validation error: one row per combination, best first, with its test error.

    Every (channel, rate) series is built once. The cross products of all of them are taken in one
    pass for the three parts; a combination's fit and its errors are blocks of those products. The
    combinations are a table and are solved batch by batch in its tasks. ``rssd`` is the distance
    between the channels' shares of effect and of spend on training rows, a second goal beside the
    error (see ``pareto_front``).
    """
    wide, names = df, {}
    for c, rates in grid.items():
        for i, a in enumerate(rates):
            names[c, a] = f"{c}_r{i}"
            wide = wide.withColumn(names[c, a], F.col(c))
    wide = adstock(wide, {n: a for (c, a), n in names.items()}, order)
    cols = [*[f"{n}_adstock" for n in names.values()], *controls]
    parts = split_by_time(wide, ts, t1, t2)
    design = cut(complete(parts, y, as_terms(cols), ["part", *grid]))
    each = moments(design, len(cols), "part")
    # Mean distance of every series from its mean, and what was spent, for the shares.
    train = design.filter("part = 'train'")
    wide_mean = {i: float(m) for i, m in enumerate(each["train"].mean[: len(names)])}
    sizes = train.agg(*[F.avg(F.abs(F.col(f"_x{i}") - F.lit(m))).alias(f"d{i}") for i, m in wide_mean.items()], *[F.sum(c).cast("double").alias(f"s_{c}") for c in grid]).first()
    spend = np.array([sizes[f"s_{c}"] or 0.0 for c in grid])
    spend = spend / (spend.sum() or 1.0)
    spread = np.array([sizes[f"d{i}"] or 0.0 for i in wide_mean])
    first = {c: cols.index(f"{names[c, rates[0]]}_adstock") for c, rates in grid.items()}
    held, k = [cols.index(c) for c in controls], len(grid)

    def solve_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [b[f"_{c}"].to_numpy(int) + first[c] for c in grid] + [np.full(len(b), i) for i in held] + [np.full(len(b), len(cols))]
            pick = np.stack(at, axis=1)
            block = lambda m: m.cross[pick[:, :, None], pick[:, None, :]]
            train = block(each["train"])
            sxx, sxy, syy = train[:, :-1, :-1], train[:, :-1, -1], train[:, -1, -1]
            scale = np.sqrt(np.where((d := np.einsum("gii->gi", sxx)) > 0, d, 1.0))
            coef = np.linalg.solve(sxx / scale[:, :, None] / scale[:, None, :], (sxy / scale)[:, :, None])[:, :, 0] / scale
            mean = each["train"].mean[pick]
            constant = mean[:, -1] - (mean[:, :-1] * coef).sum(axis=1)
            away = np.concatenate([-coef, np.ones((len(b), 1))], axis=1)
            out = {f"{c}_rate": b[c] for c in grid}
            effect = np.abs(coef[:, :k]) * spread[pick[:, :k]]
            total = effect.sum(axis=1, keepdims=True)
            out["rssd"] = np.linalg.norm(effect / np.where(total > 0, total, 1.0) - spend, axis=1)
            sse = syy - 2 * (coef * sxy).sum(axis=1) + np.einsum("gi,gij,gj->g", coef, sxx, coef)
            # Rounding can take an error of nothing just below zero.
            out["train_rmse"] = np.sqrt(np.maximum(sse, 0.0) / each["train"].n)
            for name in ("valid", "test"):
                out[f"{name}_rmse"] = None
                if name in each:
                    m = each[name]
                    bias = (away * m.mean[pick]).sum(axis=1) - constant
                    out[f"{name}_rmse"] = np.sqrt(np.maximum(0.0, np.einsum("gi,gij,gj->g", away, block(m), away) / m.n + bias * bias))
            yield pd.DataFrame(out)

    schema = ", ".join(f"{c}_rate double" for c in grid) + ", rssd double, train_rmse double, valid_rmse double, test_rmse double"
    table = combinations(df.sparkSession, {c: range(len(rates)) for c, rates in grid.items()})
    rated = {c: F.get(F.array(*[F.lit(float(a)) for a in rates]), F.col(c).cast("int")) for c, rates in grid.items()}
    table = table.select(*[F.col(c).cast("int").alias(f"_{c}") for c in grid], *[r.alias(c) for c, r in rated.items()])
    # The test rows only report; they have no say in the choice. Without validation rows the fit itself decides.
    judge = "valid_rmse" if "valid" in each else "train_rmse"
    return table.mapInPandas(solve_batch, schema).orderBy(judge, *[f"{c}_rate" for c in grid])


def search_model_size(
    df: DataFrame, y: str, order: Order, rates: Mapping[str, float], controls: Sequence[str], sizes: Sequence[tuple[int, int]], ts: str, t1, t2
) -> DataFrame:
    """Boosted trees on carried-over channels: (trees, depth) by validation error, best first, with the test error."""
    names = {c: f"{c}_adstock" for c in rates}
    parts = split_by_time(adstock(df, dict(rates), order), ts, t1, t2)
    xs, rows = [*names.values(), *controls], []
    parts = assemble(parts.select("part", y, *xs), xs)
    gap = F.pow(F.col(y) - F.col("prediction"), F.lit(2.0))
    for trees, depth in sizes:
        model = GBTRegressor(labelCol=y, maxIter=trees, maxDepth=depth, seed=1).fit(parts.filter("part = 'train'"))
        errors = {r["part"]: float(r["e"]) for r in model.transform(parts).groupBy("part").agg(F.sqrt(F.avg(gap)).alias("e")).collect()}
        rows.append((trees, depth, errors.get("train"), errors.get("valid"), errors.get("test")))
    judge = 3 if any(r[3] is not None for r in rows) else 2
    schema = "trees int, depth int, train_rmse double, valid_rmse double, test_rmse double"
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[judge]), schema)


def kmeans(df: DataFrame, features: str, k: int, seed: int = 1):
    """K-means; returns the model and the rows with a ``cluster`` column."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    return model, model.transform(df)


def silhouette(df: DataFrame, features: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Silhouette on squared Euclidean distance per k, from cluster sums rather than pairs."""
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    rows = [(int(k), float(judge.evaluate(kmeans(df, features, k, seed)[1]))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def elbow(df: DataFrame, features: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Mean distance to the nearest centre per k; the centres are literals in the plan."""
    arr, rows = df.select(vector_to_array(features).alias("x")), []
    for k in ks:
        model, _ = kmeans(df, features, k, seed)
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        gap = lambda c: F.aggregate(
            F.zip_with(F.col("x"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
        )
        rows.append((int(k), float(arr.select(F.avg(F.sqrt(F.array_min(F.transform(centres, gap))))).first()[0])))
    return df.sparkSession.createDataFrame(rows, "k int, mean_distance double")


def pca(df: DataFrame, features: str, k: int = 2) -> DataFrame:
    """Principal components of the centred vectors, as an array column ``components``."""
    centred = StandardScaler(inputCol=features, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("components", vector_to_array("_p")).drop("_c", "_p")


def importance(model, xs: Sequence[str], spark) -> DataFrame:
    rows = [(x, float(v)) for x, v in zip(xs, model.featureImportances.toArray())]
    return spark.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, importance double")


def permutation_importance(model, df: DataFrame, y: str, xs: Sequence[str], key: Sequence[str], seed: int = 1) -> DataFrame:
    """Rise of the squared error when one feature is replaced by that of another row.

    The other row is the neighbour in a hashed order, found once for all features by position.
    """
    base = df.select(*key, y, *xs).withColumn("_u", uniform(key, seed))
    moved = neighbours(base, [], ["_u", *key], lambda w: {f"_o_{x}": F.lag(x).over(w) for x in xs}, before=1)
    moved = moved.dropna(subset=[f"_o_{x}" for x in xs])
    mse = F.avg(F.pow(F.col(y) - F.col("prediction"), F.lit(2.0)))
    start = model.transform(assemble(moved, xs)).select(mse).first()[0]
    rows = []
    for x in xs:
        swapped = moved.withColumn(x, F.col(f"_o_{x}"))
        rows.append((x, float(model.transform(assemble(swapped, xs)).select(mse).first()[0] - start)))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, error_rise double")


def contributions(fit: Fit, df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Exact per-row contributions of a linear model: coef * (x - mean), as ``<x>_effect``."""
    means = dict(zip([n for n in fit.names if n != "Intercept"], fit.mean))
    return df.withColumns({f"{x}_effect": F.lit(fit[x]) * (F.col(x) - F.lit(float(means[x]))) for x in xs})


def mean_contribution(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.abs(F.col(f"{x}_effect"))).alias(x) for x in xs])
    return row.unpivot([], list(xs), "feature", "mean_abs")


def effect_vs_spend(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per channel: share of absolute effect, share of spend, and the distance between the two shares."""
    row = df.agg(*[F.sum(F.abs(F.col(f"{c}_effect"))).alias(f"e_{c}") for c in channels], *[F.sum(c).cast("double").alias(f"s_{c}") for c in channels])
    e, s = sum(F.col(f"e_{c}") for c in channels), sum(F.col(f"s_{c}") for c in channels)
    gap = F.sqrt(sum(F.pow(F.col(f"e_{c}") / e - F.col(f"s_{c}") / s, F.lit(2.0)) for c in channels))
    cells = [
        F.struct(F.lit(c).alias("channel"), (F.col(f"e_{c}") / e).alias("effect_share"), (F.col(f"s_{c}") / s).alias("spend_share"), gap.alias("rssd"))
        for c in channels
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _group_moments(k: int):
    """Moments of runs of rows (key, y, x, salt) that lie together: count, means and centred products of (x, y), upper half."""
    upper = np.triu_indices(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run of a batch may go on in the next one.
        held, last = None, None

        def out(keys: list, n: np.ndarray, mean: np.ndarray, cross: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(keys, kind), pa.array(n), pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(cross), pa.list_(pa.float64()))]
            return pa.record_batch(columns, ["key", "n", "mean", "cross"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            codes = batch.column(0).dictionary_encode()
            own, salt = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (salt[1:] != salt[:-1])]))
            z = np.column_stack([batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), batch.column(1).to_numpy(zero_copy_only=False)])
            n = np.diff(np.append(starts, len(z))).astype(float)
            # About the run's own mean, so a large mean costs no digits.
            mean = np.add.reduceat(z, starts, axis=0) / n[:, None]
            z = z - np.repeat(mean, n.astype(int), axis=0)
            cross = np.stack([np.add.reduceat(z[:, i] * z[:, j], starts) for i, j in zip(*upper)], axis=1)
            keys = [codes.dictionary[int(c)].as_py() if c >= 0 else None for c in own[starts]]
            if held is not None and last == (keys[0], salt[0]):
                m, gap = held[1][0], mean[0] - held[2][0]
                both = m + n[0]
                cross[0] += held[3][0] + m * n[0] / both * gap[upper[0]] * gap[upper[1]]
                mean[0], n[0] = held[2][0] + gap * n[0] / both, both
            elif held is not None:
                yield out(*held, kind)
            last, held = (keys[-1], salt[starts[-1]]), (keys[-1:], n[-1:], mean[-1:], cross[-1:])
            if len(keys) > 1:
                yield out(keys[:-1], n[:-1], mean[:-1], cross[:-1], kind)
        if held is not None:
            yield out(*held, kind)

    return run


def _solve_moments(k: int, alpha: float, salted: bool):
    """A model per group, from its moments; with ``salted`` a group's rows follow each other and are merged first."""
    upper = np.triu_indices(k + 1)

    def merged(b: pd.DataFrame) -> pd.DataFrame:
        n, mean, cross = float(b["n"].sum()), np.array(b["mean"].tolist()), np.array(b["cross"].tolist())
        w = b["n"].to_numpy(float)[:, None]
        centre = (w * mean).sum(axis=0) / n
        gap = mean - centre
        whole = (cross + w * gap[:, upper[0]] * gap[:, upper[1]]).sum(axis=0)
        return pd.DataFrame({"key": b["key"].iloc[:1], "n": [n], "mean": [centre], "cross": [whole]})

    def solved(b: pd.DataFrame) -> pd.DataFrame:
        mean = np.array(b["mean"].tolist()).reshape(-1, k + 1)
        whole = np.zeros((len(b), k + 1, k + 1))
        vals = np.array(b["cross"].tolist()).reshape(len(b), -1)
        whole[:, upper[0], upper[1]] = vals
        whole[:, upper[1], upper[0]] = vals
        a, r = whole[:, :k, :k], whole[:, :k, k]
        if alpha:
            w = np.linalg.solve(a + alpha * np.eye(k), r[:, :, None])[:, :, 0]
        else:
            # Columns that say nothing new in a group get no weight beyond the shortest solution.
            scale = np.sqrt(np.where((d := np.einsum("gii->gi", a)) > 0, d, 1.0))
            inverse = np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True)
            w = (inverse @ (r / scale)[:, :, None])[:, :, 0] / scale
        return pd.DataFrame({"key": b["key"], "intercept": mean[:, k] - (mean[:, :k] * w).sum(axis=1), "weights": list(w)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield solved(b)

    return (lambda b: solved(merged(b))) if salted else run


def ridge_per_group(
    df: DataFrame, by: str, y: str, xs: Sequence[str] | str, alpha: float = 0.01, dims: int | None = None, group_rows: int | None = None
) -> DataFrame:
    """A ridge model per group, intercept not penalised: (by, intercept, weights).

    ``xs`` are number columns, or the name of one array column of ``dims`` numbers. What is
    shuffled are the rows, since sums of products are many times as wide and most groups have few
    rows in a task. A group of more than ``group_rows`` is dealt to several tasks and its
    moments are merged.
    """
    k = dims if isinstance(xs, str) else len(xs)
    kind = dict(df.dtypes)[by]
    x = F.slice(F.col(xs).cast("array<double>"), 1, k) if isinstance(xs, str) else F.array(*[F.col(c).cast("double") for c in xs])
    g = df.select(F.col(by).alias("key"), F.col(y).cast("double").alias("y"), x.alias("x"))
    g = g.filter(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    limit = GROUP_ROWS if group_rows is None else group_rows
    hot = small_rows(df.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit))
    salt = F.lit(0)
    for r in hot:
        salt = F.when(F.col("key").eqNullSafe(F.lit(r["key"]).cast(kind)), F.pmod(F.xxhash64("y", "x", F.monotonically_increasing_id()), F.lit(-(-r["n"] // limit)))).otherwise(salt)
    dealt = g.withColumn("salt", salt.cast("long")).repartition("key", "salt") if hot else g.withColumn("salt", F.lit(0).cast("long")).repartition("key")
    each = dealt.sortWithinPartitions("key", "salt").mapInArrow(_group_moments(k), f"key {kind}, n double, mean array<double>, cross array<double>")
    schema = f"key {kind}, intercept double, weights array<double>"
    out = each.groupBy("key").applyInPandas(_solve_moments(k, alpha, True), schema) if hot else each.mapInPandas(_solve_moments(k, alpha, False), schema)
    return out.withColumnRenamed("key", by)


def fit_per_group(df: DataFrame, by: str, y: str, xs: Sequence[str]) -> DataFrame:
    """One least-squares model per group, by the same sums as the ridge, without a penalty."""
    return ridge_per_group(df, by, y, xs, alpha=0.0)


def model_bands(train: DataFrame, test: DataFrame, y: str, xs: Sequence[str], n: int, **gbt) -> DataFrame:
    """Boosted trees fitted on train; test predictions cut at the quantiles of the training predictions."""
    model, data = fit_gbt(train, y, xs, **gbt)
    edges = quantile_edges(model.transform(data), "prediction", n)
    return model.transform(assemble(test, xs)).withColumn("band", digitize("prediction", edges)).drop("features")


def result_table(df: DataFrame, y: str, xs: Sequence[str], ts: str, t1, t2) -> DataFrame:
    """Predictions cut to whole numbers, label and percentage error, labelled train, valid or test."""
    parts = split_by_time(df, ts, t1, t2, "data_type")
    train = parts.filter("data_type = 'train'")
    fit = fit_moments(moments(complete(train, y, as_terms(xs)), len(xs)), list(xs))
    out = parts.withColumn("predicted", fit.predict(list(xs)).cast("long")).withColumn("true_label", F.col(y))
    return out.withColumn("percentage", pct_error("predicted", "true_label"))


def daily_error(results: DataFrame, ts: str) -> DataFrame:
    """Mean absolute error of daily sums per part of the data."""
    daily = results.groupBy("data_type", F.to_date(ts).alias("_day")).agg(
        F.sum("predicted").cast("double").alias("p"), F.sum("true_label").cast("double").alias("t")
    )
    return daily.groupBy("data_type").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
