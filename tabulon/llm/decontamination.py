"""Find benchmark passages in documents by a prefix-filtered set join.

A window of an item is the set of its short word shingles in their places. To contain a window a
document must have all of its shingles, so one of them is a sufficient prefix: the rarest over all
documents. Documents are joined on these prefix shingles alone; where the window would start, and
whether it fits, follows from the place of the shingle, and the words are compared last.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.shared import null_safe, small_batches, stored, text_of

# In UTF-8 every byte of a character beyond ASCII lies above 0x7f, so bytes can stand for characters:
# A-Z become a-z, and whatever is neither digit, letter nor beyond ASCII becomes a blank.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 32 for b in range(256))
SHINGLE = 3
# Windows held by a task at a time; a larger benchmark is taken in parts of about this many.
PART_WINDOWS = 60_000
_CODE_BITS = 21


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return text.translate(_WORD_BYTES).split()


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item (as string) and window: every ``size`` consecutive words, or all words of a shorter item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for item, text in zip(rows["item"], rows["text"]):
                words = words_of(text)
                if words:
                    last = max(len(words) - size, 0)
                    for at in range(0, last + 1, 10_000):
                        some = [b" ".join(words[i : i + size]).decode() for i in range(at, min(at + 10_000, last + 1))]
                        yield pd.DataFrame({"item": [item] * len(some), "window": some})

    rows = items.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(cut, "item string, window string").distinct()


class Windows:
    """The windows of one part: their words as numbers, and their shingles as codes."""

    def __init__(self, windows: list[str]):
        words = {w: w.encode().split(b" ") for w in windows}
        self.number = {w: i for i, w in enumerate(sorted({x for ws in words.values() for x in ws}), 1)}
        if len(self.number) >> _CODE_BITS:
            raise ValueError("too many words in one part")
        self.ids = {w: np.array([self.number[x] for x in ws], np.int64) for w, ws in words.items()}
        self.sizes = sorted({min(SHINGLE, len(a)) for a in self.ids.values()})
        self.codes = np.unique(np.concatenate([shingle_codes(a, min(SHINGLE, len(a)))[1] for a in self.ids.values()] or [np.empty(0, np.int64)]))


def shingle_codes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the shingles made of known words only; a word outside the benchmark is 0."""
    if len(ids) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n, known = len(ids) - size + 1, ids > 0
    whole = known[:n].copy()
    for i in range(1, size):
        whole &= known[i : i + n]
    at = np.flatnonzero(whole)
    code = ids[at]
    for i in range(1, size):
        code = (code << _CODE_BITS) | ids[at + i]
    return at, code


def _numbers(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))


def _present(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_codes, codes)
    at[at == len(sorted_codes)] = 0
    return sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)


def shingle_counts(docs: DataFrame, part) -> DataFrame:
    """code and n: how often each shingle of the part occurs in all documents (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = part.value
        total = np.zeros(len(index.codes), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = _numbers(text, index.number)
                for size in index.sizes:
                    codes = shingle_codes(ids, size)[1]
                    codes = codes[_present(index.codes, codes)]
                    if len(codes):
                        np.add.at(total, np.searchsorted(index.codes, codes), 1)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"code": index.codes[seen], "n": total[seen]})

    return docs.select(F.col("text").cast("binary")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Prefixes:
    """For each prefix shingle the places it has in windows; and the windows by their words."""

    def __init__(self, index: Windows, counts: dict[int, int]):
        self.number, self.window_of = index.number, {}
        places: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for window, ids in index.ids.items():
            size = min(SHINGLE, len(ids))
            at, codes = shingle_codes(ids, size)
            # Rarest first; a window with a shingle that no document has cannot occur.
            least, code, place = min((counts.get(int(c), 0), int(c), int(a)) for a, c in zip(at, codes))
            if least:
                places[size][code].add((place, len(ids)))
                self.window_of[ids.tobytes()] = window
        self.places = {size: {c: sorted(p) for c, p in by.items()} for size, by in places.items()}
        self.codes = {size: np.array(sorted(by), np.int64) for size, by in places.items()}

    def find(self, ids: np.ndarray) -> list[tuple[int, int, str]]:
        """start, end and words of every window that occurs in the words ``ids``."""
        out = []
        for size, prefix in self.codes.items():
            at, codes = shingle_codes(ids, size)
            own = _present(prefix, codes)
            for pos, code in zip(at[own].tolist(), codes[own].tolist()):
                for place, length in self.places[size][code]:
                    start = pos - place
                    # The window must lie inside the document.
                    if start >= 0 and start + length <= len(ids):
                        window = self.window_of.get(ids[start : start + length].tobytes())
                        if window is not None:
                            out.append((start, start + length, window))
        return out


def _search(docs: DataFrame, prefixes) -> DataFrame:
    """docs with n_words, n_hit, the merged spans that windows cover, and the windows found."""

    @F.pandas_udf("n_words long, n_hit long, starts array<long>, ends array<long>, windows array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = prefixes.value
        for texts in batches:
            rows = []
            for text in texts:
                ids = _numbers(text, index.number)
                found = index.find(ids)
                starts, ends = merged([(a, b) for a, b, _ in found])
                rows.append((len(ids), sum(ends) - sum(starts), starts, ends, sorted({w for _, _, w in found})))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "starts", "ends", "windows"])

    return docs.withColumn("s", search(F.col("text").cast("binary"))).select("id", "mark", "s.*")


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of half-open spans."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _covered(starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(starts, ends):
        s, e = merged(list(zip(map(int, a), map(int, b))))
        out.append(sum(e) - sum(s))
    return pd.Series(out, dtype="int64")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    one_in: int = 20,
    part_windows: int = PART_WINDOWS,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A-Z are lower-cased; words are runs of digits, letters and characters beyond ASCII. A word is
    hit if it lies in an occurrence of a window: ``size`` consecutive words of an item, or all
    words of a shorter one. Contaminated means that at least one word and at least one
    in ``one_in`` words is hit. Null and empty texts have no words; items without words match nothing;
    items without id hit words but are not counted; repeated items are one. Repeated documents are
    judged alike and null ids kept. Tables without rows give no rows, or no hits. Other columns
    are not read.

    A task holds one part of the windows, of about ``part_windows``; each further part reads the
    documents again.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    pairs = stored(benchmark_windows(items, item_id, item_text, size), "windows")
    distinct = pairs.select("window").distinct()
    parts = max(1, -(-distinct.count() // part_windows))
    found = None
    for p in range(parts):
        own = distinct.filter(F.pmod(F.xxhash64(F.lit(7), "window"), F.lit(parts)) == p).collect()
        index = Windows([r["window"] for r in own])
        shipped = spark.sparkContext.broadcast(index)
        counts = {r["code"]: r["n"] for r in shingle_counts(rows, shipped).collect()} if own else {}
        prefixes = spark.sparkContext.broadcast(Prefixes(index, counts))
        part = _search(rows, prefixes)
        found = part if found is None else found.unionByName(part)
    if parts > 1:
        copies = F.count(F.lit(1)) / F.lit(parts)
        found = found.groupBy("id", "mark").agg(
            copies.cast("int").alias("copies"), F.max("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "windows")],
        )
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
        # Spans of different parts may overlap.
        found = found.withColumn("n_hit", F.pandas_udf(_covered, "long")("starts", "ends"))
    found = stored(found.select("id", "mark", "n_words", "n_hit", "windows"), "contamination", compact=True)
    hits = found.filter("n_hit > 0").select("id", "mark", F.explode("windows").alias("window")).distinct()
    lists = hits.join(pairs, "window").groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = lists.withColumnsRenamed({"id": "_id", "mark": "_mark"})
    out = found.join(lists, null_safe(found, lists, {"id": "_id", "mark": "_mark"}), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(one_in) >= F.col("n_words"))).alias("contaminated"),
        F.col("mark").alias("text_mark"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text_col, **how).filter("contaminated")
    bad = stored(bad.select(F.col(id_col).alias("_gone"), F.col("text_mark").alias("_mark")).distinct(), "contaminated")
    cond = docs[id_col].eqNullSafe(bad["_gone"]) & (F.xxhash64(text_of(text_col)) == bad["_mark"])
    return docs.join(bad, cond, "left_anti")
