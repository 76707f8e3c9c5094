"""Column expressions. All run inside generated code; none needs a Python worker."""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.plans.quantiles import quantile_edges


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text


def normalize_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Strip and lower-case the given columns, or every string column."""
    cols = cols or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in cols})


def re_replace_first(c: Column | str, pattern: str, to: str) -> Column:
    """Replace the first match only. Groups of the pattern count from $2."""
    return F.regexp_replace(_c(c), rf"(?s)^(.*?){pattern}", "$1" + to)


def clean_name(c: Column | str) -> Column:
    """Drop bracketed text, turn punctuation into spaces and squeeze white space."""
    out = F.regexp_replace(_c(c), r"\[[^\]]*\]|\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\p{Punct}", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def translate_punct(c: Column | str) -> Column:
    return F.translate(_c(c), PUNCTUATION, " " * len(PUNCTUATION))


def concat_cols(cols: Sequence[Column | str], sep: str) -> Column:
    """Join texts with a separator; any NULL part makes the result NULL."""
    parts = [x for c in cols for x in (F.lit(sep), _c(c).cast("string"))][1:]
    return F.concat(*parts)


def word_count(c: Column | str, none_text: str | None = None) -> Column:
    """Number of pieces between single spaces; the sentinel for "no text" counts 0."""
    n = F.size(F.split(_c(c), " "))
    return n if none_text is None else F.when(_c(c) == none_text, 0).otherwise(n)


def split_parts(c: Column | str, sep: str, n: int, default: str) -> list[Column]:
    """First n parts of a path, with a default for missing ones."""
    import re

    parts = F.split(_c(c), re.escape(sep))
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit(default)) for i in range(n)]


def url_basename(c: Column | str) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def itemset_label(c: Column | str) -> Column:
    return F.array_join(F.sort_array(_c(c)), " + ")


# Dates


def time_extract(c: Column | str) -> dict[str, Column]:
    c = _c(c)
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)}


def time_cycle(c: Column | str, period: float) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * _c(c) / F.lit(float(period))
    return {"sin": F.sin(angle), "cos": F.cos(angle)}


def time_feature(c: Column | str) -> Column:
    """Month number minus day of the month."""
    return F.month(_c(c)) - F.dayofmonth(_c(c))


# Numbers


def pct_error(pred: Column | str, true: Column | str) -> Column:
    """pred / true - 1; NULL for a zero truth."""
    return F.try_divide(_c(pred).cast("double"), _c(true).cast("double")) - 1


def log_ratio(a: Column | str, b: Column | str) -> Column:
    return F.log(F.try_divide(_c(a).cast("double"), _c(b).cast("double")))


def round_to(c: Column | str, d: int) -> Column:
    """Round half to even."""
    return F.bround(_c(c), d)


def cut(c: Column | str, edges: Sequence[float], labels: Sequence | None = None, include_lowest: bool = False) -> Column:
    """Label of the interval (a, b] that holds the value; NULL outside."""
    c, out = _c(c), None
    names = labels or [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    for i, (a, b, label) in enumerate(zip(edges, edges[1:], names)):
        low = c >= F.lit(a) if include_lowest and i == 0 else c > F.lit(a)
        out = (F.when if out is None else out.when)(low & (c <= F.lit(b)), F.lit(label))
    return out


def digitize(c: Column | str, edges: Sequence[float], clip: bool = True) -> Column:
    """Index of the interval [a, b), counted from 1; clipped to 1..n of n intervals if asked. NULL stays NULL."""
    i = reduce(add, [(_c(c) >= F.lit(e)).cast("int") for e in edges])
    # least and greatest pass over NULL, so it is kept out of them.
    return F.when(_c(c).isNotNull(), F.greatest(F.lit(1), F.least(i, F.lit(len(edges) - 1)))) if clip else i


def qcut(df: DataFrame, c: str, q: int, name: str = "bin") -> tuple[DataFrame, list[float]]:
    """Equal-count bins 1..q by exact quantiles, and the edges."""
    edges = quantile_edges(df, c, q)
    return df.withColumn(name, cut(c, edges, list(range(1, q + 1)), include_lowest=True)), edges


def stars(p: Column | str) -> Column:
    """Significance marks of a p value."""
    p = _c(p)
    return F.when(p < 1e-6, "***").when(p < 1e-3, "**").when(p < 1e-2, "*").otherwise("")


# Row vectors


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(c)))


def relu(c: Column | str) -> Column:
    return F.greatest(_c(c), F.lit(0.0))


def arr_sum(arr: Column | str) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x.cast("double"))


def softmax(arr: Column | str) -> Column:
    arr = _c(arr)
    e = F.transform(arr, lambda x: F.exp(x - F.array_max(arr)))
    return F.transform(e, lambda x: x / arr_sum(e))


def cross_entropy(y: Column | str, p: Column | str) -> Column:
    """-sum(y * ln p); classes with y = 0 add nothing."""
    terms = F.zip_with(_c(y), _c(p), lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(-a * F.log(b)))
    return arr_sum(terms)


def dot(a: Column | str, b: Column | str) -> Column:
    return arr_sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def one_hot(c: Column | str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == _c(c)).cast("int"))


# Lists, maps, structs


def explode(df: DataFrame, c: str, outer: bool = False) -> DataFrame:
    return df.withColumn(c, (F.explode_outer if outer else F.explode)(c))


def flatten(c: Column | str) -> Column:
    return F.flatten(_c(c))


def arr_map(c: Column | str, fn: Callable) -> Column:
    return F.transform(_c(c), fn)


def arr_filter(c: Column | str, fn: Callable) -> Column:
    return F.filter(_c(c), fn)


def arr_fold(c: Column | str, zero, fn: Callable) -> Column:
    return F.aggregate(_c(c), F.lit(zero), fn)


def arr_has(arr: Column | str, v) -> Column:
    return F.array_contains(_c(arr), v)


def context_slice(arr: Column | str, i: Column | str, w: int) -> Column:
    """The w elements on either side of position i (from 1), without element i."""
    arr, i = _c(arr), _c(i).cast("int")
    start = F.greatest(F.lit(1), i - w)
    return F.concat(F.slice(arr, start, i - start), F.slice(arr, i + 1, F.lit(w)))


def map_lookup(df: DataFrame, dim: DataFrame, key: str, k: str, v: str) -> DataFrame:
    """Add ``v`` by key, NULL for an unknown key. Of entries that repeat a key the smallest value counts."""
    entries = dim.groupBy(F.col(k).alias(key)).agg(F.min(v).alias(v))
    return df.join(entries, key, "left")


def expand_struct(df: DataFrame, c: str) -> DataFrame:
    return df.select(*[x for x in df.columns if x != c], f"{c}.*")


def map_to_rows(df: DataFrame, c: str, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(*[x for x in df.columns if x != c], F.explode(c).alias(key, value))


def columns_as_map(cols: Mapping[str, Column | str]) -> Column:
    return F.create_map(*[x for n, c in cols.items() for x in (F.lit(n), _c(c))])
