"""Least squares, logit, diagnostics and error figures."""

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.reshape import levels
from tabulon.plans.gram import Fit, Terms, as_terms, complete, fit_moments, moments


def ols1(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Simple regression in one aggregate."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def ols(df: DataFrame, y: str, terms: Terms, intercept: bool = True) -> Fit:
    """Multiple least squares from one pass of cross products; rows with a gap are left out."""
    cols = as_terms(terms)
    return fit_moments(moments(complete(df, y, cols), len(cols)), list(cols), intercept)


def powers(c: str, degree: int) -> dict[str, Column]:
    """Polynomial terms x, x^2, .."""
    return {c if d == 1 else f"{c}^{d}": F.pow(F.col(c).cast("double"), F.lit(float(d))) for d in range(1, degree + 1)}


def categorical(df: DataFrame, c: str, values: Sequence | None = None) -> dict[str, Column]:
    """Treatment coding: a 0/1 column per level, without the first level in sorted order."""
    found = sorted(values) if values is not None else levels(df, c)
    return {f"{c}[{v}]": (F.col(c) == F.lit(v)).cast("double") for v in found[1:]}


def interact(a: Mapping[str, Column], b: Mapping[str, Column]) -> dict[str, Column]:
    """Products of every term of a with every term of b, without the main effects."""
    return {f"{n}:{m}": x.cast("double") * z.cast("double") for n, x in a.items() for m, z in b.items()}


def numeric(*cols: str) -> dict[str, Column]:
    return {c: F.col(c).cast("double") for c in cols}


def diagnostics(df: DataFrame, y: str, terms: Terms) -> DataFrame:
    """Fitted value, residual, leverage and standardised residual on every complete row."""
    cols = as_terms(terms)
    fit = ols(df, y, cols)
    names = list(cols)
    lever = F.lit(1.0 / fit.n)
    d = [cols[n] - F.lit(float(m)) for n, m in zip(names, fit.mean)]
    for i in range(len(names)):
        for j in range(len(names)):
            lever = lever + F.lit(float(fit.core[i, j])) * d[i] * d[j]
    s = float(np.sqrt(fit.sse / fit.dof))
    out = df.withColumn("fitted", fit.predict(cols)).withColumn("leverage", lever).withColumn("residual", F.col(y) - F.col("fitted"))
    return out.withColumn("std_residual", F.col("residual") / (F.lit(s) * F.sqrt(1 - F.col("leverage"))))


def residuals(df: DataFrame, y: str, terms: Terms, name: str) -> DataFrame:
    cols = as_terms(terms)
    return df.withColumn(name, F.col(y) - ols(df, y, cols).predict(cols))


def partial_out(df: DataFrame, y: str, d: str, xs: Terms) -> DataFrame:
    """Effect of d on y after both are freed of xs: equals the coefficient of the long model."""
    out = residuals(residuals(df, y, xs, "_ry"), d, xs, "_rd")
    return ols1(out, "_ry", "_rd").select("slope")


def logit(df: DataFrame, y: str, terms: Terms) -> DataFrame:
    """Logit with standard errors, p values, 95% interval and odds ratios."""
    cols = as_terms(terms)
    design = complete(df, y, cols)
    data = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_f").transform(design)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_f", labelCol="_y", maxIter=50, tol=1e-10).fit(data)
    s = model.summary
    coef = [*model.coefficients.toArray().tolist(), model.intercept]
    rows = [
        (n, float(b), float(se), float(p), float(np.exp(b)), float(np.exp(b - 1.96 * se)), float(np.exp(b + 1.96 * se)))
        for n, b, se, p in zip([*cols, "Intercept"], coef, s.coefficientStandardErrors, s.pValues)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, se double, p double, odds_ratio double, low double, high double"
    )


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, MAPE and R2 in one pass."""
    e = F.col(y).cast("double") - F.col(p)
    mse = F.avg(e * e)
    return df.groupBy(*by).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(F.try_divide(e, F.col(y).cast("double")))).alias("mape"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
