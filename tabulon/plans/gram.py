"""Least squares from sums of products. The data stay on the cluster; k x k numbers come back."""

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.tails import f_sf, t_ppf, t_sf

Terms = Mapping[str, Column] | Sequence[str]


def as_terms(terms: Terms) -> dict[str, Column]:
    if isinstance(terms, Mapping):
        return {n: c.cast("double") for n, c in terms.items()}
    return {t: F.col(t).cast("double") for t in terms}


def complete(df: DataFrame, y: str | None, terms: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Design columns _x0.. and response _y, without rows that miss a value."""
    cols = [c.alias(f"_x{i}") for i, c in enumerate(terms.values())]
    if y is not None:
        cols.append(F.col(y).cast("double").alias("_y"))
    names = [f"_x{i}" for i in range(len(terms))] + (["_y"] if y is not None else [])
    return df.select(*keep, *cols).filter(all_present(names))


def all_present(names: Sequence[str]) -> Column:
    """No value missing, as one test: a test per column makes the optimizer's work grow with 2^columns."""
    return F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda v: v.isNotNull())


@dataclass
class Moments:
    """Count, means and centred cross products of (x0, .., xk-1, y)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray
    entities: int = 0

    def __sub__(self, other: "Moments") -> "Moments":
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / n
        raw = lambda m: m.cross + m.n * np.outer(m.mean, m.mean)
        return Moments(n, mean, raw(self) - raw(other) - n * np.outer(mean, mean))


# Up to so many columns the products are sums of their own; beyond, tasks multiply whole batches.
NARROW = 12


def _batch_sums(cols: list[str], centre: np.ndarray, keyed: bool):
    """Count, sums and products of a task's rows per group, as rows (group, row of the matrix, its numbers).

    The last row and column stand for a column of ones: sums and count.
    """
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(k).type
            x = np.stack([batch.column(i).to_numpy() for i in range(k)], axis=1) - centre
            codes = batch.column(k).dictionary_encode()
            own = codes.indices.fill_null(-1).to_numpy() if keyed else np.zeros(len(x), int)
            for g in np.unique(own):
                some = np.column_stack([x[own == g], np.ones((own == g).sum())])
                name = codes.dictionary[int(g)].as_py() if keyed and g >= 0 else None
                held[name] = held.get(name, 0.0) + some.T @ some
        for name, m in held.items():
            yield pa.record_batch([pa.array([name] * (k + 1), kind), pa.array(range(k + 1), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["g", "i", "m"])

    return run


def _wide_rows(design: DataFrame, cols: list[str], centre: np.ndarray, by: str | None) -> list[tuple[object, np.ndarray]]:
    """Matrix of products of (cols, 1) per group, summed place by place."""
    group = F.col(by).alias("g") if by else F.lit(0).alias("g")
    kind = dict(design.dtypes)[by] if by else "int"
    partial = design.select(*cols, group).mapInArrow(_batch_sums(cols, centre, by is not None), f"g {kind}, i int, m array<double>")
    summed = partial.select("g", "i", F.posexplode("m").alias("j", "v")).groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[object, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["g"], np.zeros((len(cols) + 1, len(cols) + 1)))[r["i"], r["j"]] = r["v"]
    return list(out.items())


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moments(
    design: DataFrame, k: int, by: str | None = None, centred: bool = False, entity: str | None = None
) -> Moments | dict:
    """Cross products in one pass over the data.

    Products are taken about a rough centre, so large means lose no digits; any centre gives the
    same result, and a few rows are enough to find one. ``centred`` says the columns already have
    mean zero. With ``by`` (a few groups, such as folds) a dict of moments per group; with
    ``entity`` the distinct entities are counted along (as ``entities``).
    """
    cols = [f"_x{i}" for i in range(k)] + ["_y"]
    centre = np.zeros(len(cols))
    if not centred:
        some = design.select(*cols).head(200)
        if not some:
            raise ValueError("no complete rows")
        centre = np.array([list(r) for r in some], dtype=float).mean(axis=0)
    d = {c: F.col(c) - F.lit(float(m)) for c, m in zip(cols, centre)}
    if len(cols) > NARROW:
        counts = {r[0]: r[1] for r in design.groupBy(F.col(by) if by else F.lit(0).alias("g")).agg(F.count_distinct(entity)).collect()} if entity else {}
        out = {}
        for g, m in _wide_rows(design, cols, centre, by):
            n, shift = m[-1, -1], m[-1, :-1] / m[-1, -1]
            out[g] = Moments(n, centre + shift, m[:-1, :-1] - n * np.outer(shift, shift), counts.get(g if by else 0, 0))
        return out if by else next(iter(out.values()))
    sums = [F.count("*").alias("n"), *[F.sum(d[c]).alias(f"s{i}") for i, c in enumerate(cols)]]
    sums += [F.sum(d[cols[i]] * d[cols[j]]).alias(f"p{i}_{j}") for i, j in _pairs(len(cols))]
    if entity:
        sums.append(F.count_distinct(entity).alias("entities"))
    rows = design.groupBy(*([by] if by else [])).agg(*sums).collect()

    def unpack(r) -> Moments:
        shift = np.array([r[f"s{i}"] for i in range(len(cols))]) / r["n"]
        cross = np.zeros((len(cols), len(cols)))
        for i, j in _pairs(len(cols)):
            cross[i, j] = cross[j, i] = r[f"p{i}_{j}"] - r["n"] * shift[i] * shift[j]
        return Moments(r["n"], centre + shift, cross, r["entities"] if entity else 0)

    return {r[by]: unpack(r) for r in rows} if by else unpack(rows[0])


# Up to so many unknowns LAPACK works in one thread. Its threaded form can hang beside a running JVM.
ONE_THREAD = 32


def _eliminate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a x = b by elimination with row exchange, one rank-1 update per unknown."""
    n = len(a)
    if n <= ONE_THREAD:
        return np.linalg.solve(a, b)
    both = np.concatenate([a, b.reshape(n, -1)], axis=1).astype(float)
    for i in range(n):
        p = i + int(np.argmax(np.abs(both[i:, i])))
        if both[p, i] == 0:
            raise np.linalg.LinAlgError("Singular matrix")
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0.0
        both -= factors[:, None] * both[i]
    return both[:, n:].reshape(b.shape)


def _scale(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = _scale(a)
    return (_eliminate(a / np.outer(scale, scale), (b.T / scale).T).T / scale).T


def inverse(a: np.ndarray) -> np.ndarray:
    scale = _scale(a)
    if len(a) <= ONE_THREAD:
        return np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    return _eliminate(a / np.outer(scale, scale), np.eye(len(a))) / np.outer(scale, scale)


@dataclass
class Fit:
    """A fitted linear model: small enough to hold on the driver."""

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: float
    dof: float
    sse: float
    sst: float
    intercept: bool
    mean: np.ndarray = field(default=None)
    core: np.ndarray = field(default=None)

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def __getitem__(self, name: str) -> float:
        return float(self.coef[self.names.index(name)])

    def predict(self, terms: Terms) -> Column:
        cols = as_terms(terms)
        out = F.lit(self["Intercept"] if self.intercept else 0.0)
        for n, c in cols.items():
            out = out + F.lit(self[n]) * c
        return out

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """term, coef, se, t, p and the interval."""
        q = t_ppf(0.5 + level / 2, self.dof)
        rows = []
        for name, b, s in zip(self.names, self.coef, self.se):
            t = float(b / s)
            rows.append((name, float(b), float(s), t, float(2 * t_sf(abs(t), self.dof)), float(b - q * s), float(b + q * s)))
        return spark.createDataFrame(rows, "term string, coef double, se double, t double, p double, low double, high double")

    def summary(self, spark) -> DataFrame:
        k = len(self.names) - int(self.intercept)
        adj = 1 - (1 - self.r2) * (self.n - int(self.intercept)) / self.dof
        f = float(((self.sst - self.sse) / k) / (self.sse / self.dof))
        row = (int(self.n), float(self.r2), float(adj), f, float(f_sf(f, k, self.dof)), float(self.sse))
        return spark.createDataFrame([row], "n long, r2 double, adj_r2 double, f double, p_f double, sse double")


def fit_moments(m: Moments, names: Sequence[str], intercept: bool = True, lost: float = 0) -> Fit:
    """Solve the normal equations. ``lost`` are further degrees of freedom already used."""
    k = len(names)
    if intercept:
        sxx, sxy, syy = m.cross[:k, :k], m.cross[:k, k], m.cross[k, k]
    else:
        raw = m.cross + m.n * np.outer(m.mean, m.mean)
        sxx, sxy, syy = raw[:k, :k], raw[:k, k], raw[k, k]
    inv = inverse(sxx)
    beta = solve(sxx, sxy)
    sse = max(float(syy - 2 * beta @ sxy + beta @ sxx @ beta), 0.0)
    dof = m.n - k - int(intercept) - lost
    s2 = sse / dof if dof > 0 else float("nan")
    if not intercept:
        return Fit(list(names), beta, s2 * inv, m.n, dof, sse, float(syy), False, m.mean[:k], inv)
    mean = m.mean[:k]
    side = -inv @ mean
    cov = np.block([[np.array([[1 / m.n + mean @ inv @ mean]]), side[None, :]], [side[:, None], inv]])
    coef = np.concatenate([[m.mean[k] - mean @ beta], beta])
    return Fit(["Intercept", *names], coef, s2 * cov, m.n, dof, sse, float(syy), True, mean, inv)
