"""Passages that repeat word for word across documents, by a sparse suffix array.

Of the suffixes of all documents those at minimiser places are kept: every passage of the least
length has exactly one place that is least in it, and equal passages have it at the same word. The
kept suffixes carry the words around them that passages of that place can reach, are sorted by
range over the whole table, and each is compared with its neighbours: matches are extended word by
word to the right and to the left, and what they cover together is joined into passages.

The neighbour that shares most to the right need not share most to the left. So where more
suffixes begin alike than a suffix is compared with, those of its passages that no neighbour has
covered are looked up by the hash of their words among all passages of such suffixes.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulon.llm.shared import small_batches, stored, text_of
from tabulon.llm.words import kmer_hashes, minimisers, word_hashes

LEAST_WORDS, KMER = 50, 8
# Neighbours before and after that a suffix is compared with.
NEIGHBOURS = 8
# Bytes of a word's hash that are sorted and compared.
CODE = 3
_SENT = 4_000
NO_ID = -(1 << 63)

_ROWS = "id long, right binary, left binary, at binary"
_FOUND = "id long, at binary, before int, after int, least_other long, edge int, right binary, left binary, passage long"


def _suffixes(least_words: int, kmer: int):
    """Kept suffixes: words from the place on, words before it from last to first, and its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, right, left, at = zip(*rows)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip((ids, right, left, at), kinds)], ["id", "right", "left", "at"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = word_hashes(text)
                places, first, last = minimisers(kmer_hashes(h, kmer), least_words - kmer + 1)
                if not len(places):
                    continue
                codes = h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
                ahead, back, n = codes.tobytes(), codes[::-1].tobytes(), len(h)
                # Equal surroundings within a document are one row with several places.
                own: dict[tuple[bytes, bytes], list[int]] = {}
                for p, a, b in zip(places.tolist(), first.tolist(), last.tolist()):
                    key = ahead[CODE * p : CODE * (b + least_words)], back[CODE * (n - p) : CODE * (n - a)]
                    own.setdefault(key, []).append(p)
                for (right, left), at in own.items():
                    rows.append((doc, right, left, np.array(at, "<i4").tobytes()))
                    if len(rows) >= _SENT:
                        yield out()
                        rows.clear()
        if rows:
            yield out()

    return run


class _Rows:
    """Sorted suffixes as arrays; surroundings padded to the longest."""

    def __init__(self, id, right, left, at, least_words: int):
        self.id, self.at = np.asarray(id, np.int64), list(at)
        self.raw = list(right), list(left)
        self.right, self.rights = _matrix(self.raw[0], least_words)
        self.left, self.lefts = _matrix(self.raw[1], least_words)

    def __len__(self) -> int:
        return len(self.id)


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, one row per value, and how many each has."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // CODE
    out = np.zeros((len(values), width), np.uint32)
    if len(values):
        data = np.frombuffer(b"".join(values), np.uint8).reshape(-1, CODE).astype(np.uint32)
        word = data[:, 0] << 16 | data[:, 1] << 8 | data[:, 2]
        out[np.arange(width) < size[:, None]] = word
    return out, size


def _shared(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> np.ndarray:
    """Leading words that rows of a and b have in common."""
    width = a.shape[1]
    same = (a == b) & (np.arange(width) < np.minimum(an, bn)[:, None])
    return np.where(same.all(axis=1), width, same.argmin(axis=1))


def _compare(rows: _Rows, least_words: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row how far matches reach back and ahead, and the smallest other document."""
    n = len(rows)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    other = np.full(n, np.iinfo(np.int64).max)
    # Only rows that begin with the same k words can match.
    head = rows.right[:, :kmer]
    group = np.append(0, np.cumsum((head[1:] != head[:-1]).any(axis=1))) if n else np.zeros(0, int)
    for step in range(1, min(NEIGHBOURS, n - 1) + 1):
        j = np.flatnonzero((group[step:] == group[: n - step]) & (rows.id[step:] != rows.id[: n - step]))
        if not len(j):
            continue
        i = j + step
        ahead = _shared(rows.right[i], rows.rights[i], rows.right[j], rows.rights[j])
        back = _shared(rows.left[i], rows.lefts[i], rows.left[j], rows.lefts[j])
        enough = ahead + back >= least_words
        i, j, ahead, back = i[enough], j[enough], ahead[enough], back[enough]
        for own, with_ in ((i, j), (j, i)):
            np.maximum.at(before, own, back)
            np.maximum.at(after, own, ahead)
            np.minimum.at(other, own, rows.id[with_])
    return before, after, other


def _found(rows: _Rows, least_words: int, kmer: int) -> dict:
    before, after, other = _compare(rows, least_words, kmer)
    hit = np.flatnonzero(after)
    return {"id": rows.id[hit], "at": [rows.at[i] for i in hit], "before": before[hit], "after": after[hit], "least_other": other[hit]}


def _open(rows: _Rows, kmer: int, first: bool, last: bool) -> np.ndarray:
    """Rows that begin like the row farthest compared on either side, or like the border of the task."""
    head, n = rows.right[:, :kmer], len(rows)
    i = np.arange(n)
    back = (head == head[np.maximum(i - NEIGHBOURS, 0)]).all(axis=1) & (first | (i >= NEIGHBOURS))
    ahead = (head == head[np.minimum(i + NEIGHBOURS, n - 1)]).all(axis=1) & (last | (i + NEIGHBOURS < n))
    return back | ahead


def _passages(rows: _Rows, chosen: np.ndarray, least_words: int, kmer: int) -> dict:
    """Passages of the chosen rows by hash.

    Those that lie outside what the row's neighbours have matched, one by one. The covered ones
    too, since another row's uncovered passage may be among them, but each once: without a place,
    from its smallest document (id) to its largest (least_other).
    """
    if not len(chosen):
        return {"id": []}
    before, after, _ = _compare(rows, least_words, kmer)
    before, after, ids = before[chosen], after[chosen], rows.id[chosen]
    # Equal surroundings lie together and are hashed once.
    i, j = chosen[1:], chosen[:-1]
    new = (rows.right[i] != rows.right[j]).any(axis=1) | (rows.left[i] != rows.left[j]).any(axis=1)
    new |= (rows.rights[i] != rows.rights[j]) | (rows.lefts[i] != rows.lefts[j])
    first, kind = np.append(0, np.flatnonzero(new) + 1), np.append(0, np.cumsum(new))
    one, low, high = chosen[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    own, back, hashes, covered = [], [], [], []
    for o in range(int(rows.lefts[one].max()) + 1):
        ahead = least_words - o
        fits = (rows.lefts[one] >= o) & (rows.rights[one] >= ahead)
        if not fits.any():
            continue
        words = np.concatenate([rows.left[one[fits], :o][:, ::-1], rows.right[one[fits], :ahead]], axis=1).astype(np.uint64)
        h = np.zeros(len(one), np.int64)
        h[fits] = kmer_hashes(words.T, least_words)[0].view(np.int64)
        outside = (before < o) | (after < ahead)
        i = np.flatnonzero(fits[kind] & outside)
        own.append(i)
        back.append(np.full(len(i), o))
        hashes.append(h[kind[i]])
        c = np.unique(kind[fits[kind] & ~outside])
        covered.append(np.stack([h[c], low[c], high[c]]))
    if not own:
        return {"id": []}
    i, back, hashes, (h, low, high) = np.concatenate(own), np.concatenate(back), np.concatenate(hashes), np.concatenate(covered, axis=1)
    if len(h):
        order = np.argsort(h, kind="stable")
        first = np.append(0, np.flatnonzero(np.diff(h[order])) + 1)
        h, low, high = h[order][first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    none = np.zeros(len(h), np.int64)
    return {
        "id": np.append(ids[i], low), "at": [rows.at[k] for k in chosen[i]] + [None] * len(h), "before": np.append(back, none),
        "after": np.append(least_words - back, none), "least_other": np.append(ids[i], high), "passage": np.append(hashes, h),
    }


def _neighbours(least_words: int, kmer: int):
    """Matches among the sorted rows of a task, its first and last rows for the tasks beside it, and open passages."""
    keep = 2 * NEIGHBOURS

    def batch_of(columns: dict, edge: int | None = None) -> pa.RecordBatch:
        n = len(columns["id"])
        empty = [None] * n
        return pa.record_batch([
            pa.array(columns["id"], pa.int64()), pa.array(columns.get("at", empty), pa.binary()),
            pa.array(columns.get("before", empty), pa.int32()), pa.array(columns.get("after", empty), pa.int32()),
            pa.array(columns.get("least_other", empty), pa.int64()), pa.array([edge] * n, pa.int32()),
            pa.array(columns.get("right", empty), pa.binary()), pa.array(columns.get("left", empty), pa.binary()),
            pa.array(columns.get("passage", empty), pa.int64()),
        ], ["id", "at", "before", "after", "least_other", "edge", "right", "left", "passage"])

    def edge_rows(rows: list[tuple], edge: int) -> pa.RecordBatch:
        return batch_of(dict(zip(("id", "right", "left", "at"), (list(c) for c in zip(*rows)))), edge)

    def open_rows(rows: _Rows, first: bool, last: bool) -> pa.RecordBatch:
        i = np.flatnonzero(_open(rows, kmer, first, last))
        # The first and last rows held are seen with all their neighbours in the batch before or after.
        inside = (first | (i >= NEIGHBOURS)) & (last | (i < len(rows) - NEIGHBOURS))
        return batch_of(_passages(rows, i[inside], least_words, kmer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []
        first, part = True, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            if part is None and batch.num_rows:
                part = batch.column(4)[0].as_py()
                yield edge_rows(list(zip(*columns))[:NEIGHBOURS], part)
            held = [list(c) for c in zip(*tail)] or [[], [], [], []]
            rows = _Rows(*[a + b for a, b in zip(held, columns)], least_words)
            if batch.num_rows:
                yield batch_of(_found(rows, least_words, kmer))
            if len(rows) > keep:
                yield open_rows(rows, first, False)
                first = False
            tail = list(zip(rows.id.tolist(), *rows.raw, rows.at))
            tail = tail if first else tail[-keep:]
        if tail:
            rows = _Rows(*[list(c) for c in zip(*tail)], least_words)
            yield open_rows(rows, first, True)
            # The rows after the end of this task are the first of the next.
            yield edge_rows(tail[-NEIGHBOURS:], part + 1)

    return run


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, kmer: int = KMER
) -> DataFrame:
    """Maximal passages of at least ``least_words`` words that also stand in another document.

    One row per passage: id, start and end in words (end exclusive), n_words, other_id (the
    smallest other document met) and later (whether other_id is smaller, so that this copy may
    go). Words are split at ASCII blanks and A-Z lower-cased. Documents are told apart by their
    integer id; rows with one id, or without id, count as one document, so repeats within it are
    not reported. Null, empty and short texts have no passage; an empty table gives no rows. Other
    columns are not read.

    Suffixes with equal beginnings lie together, spread over
    tasks by document, each compared with ``NEIGHBOURS`` others on either side, across the borders
    of tasks too. Words are compared by 24 bits of their hashes.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).cast("binary").alias("text"))
    kept = texts.mapInArrow(_suffixes(least_words, kmer), _ROWS)
    # The bounds between tasks are drawn from the first words alone, since whole rows would make a large
    # sample. Rows that begin alike may be dealt over several tasks, those with equal words side by side;
    # they all count as open there.
    ranges = kept.repartitionByRange(F.substring("right", 1, kmer * CODE), F.xxhash64("right", "left"), "id")
    ordered = ranges.sortWithinPartitions("right", "left", "id", "at").withColumn("part", F.spark_partition_id())
    found = stored(ordered.mapInArrow(_neighbours(least_words, kmer), _FOUND), "suffixes")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["right", "left", "id", "at"]).drop_duplicates(["id", "right", "left", "at"])
        rows = _Rows(pdf["id"], pdf["right"], pdf["left"], pdf["at"], least_words)
        return pd.DataFrame(_found(rows, least_words, kmer))

    # At most NEIGHBOURS rows from either side of each border.
    borders = found.filter("edge is not null").groupBy("edge").applyInPandas(across, "id long, at binary, before int, after int, least_other long")
    fields = ["id", "at", "before", "after", "least_other"]
    matches = found.filter("edge is null and passage is null").select(*fields).unionByName(borders)
    # Uncovered passages that two documents have, the other's covered or not: an aggregate that is partial in each task, then a look-up.
    open_ = found.filter("passage is not null")
    owners = open_.groupBy("passage").agg(F.min("id").alias("low"), F.max("least_other").alias("high"), F.max(F.col("at").isNotNull()).alias("uncovered"))
    shared = stored(owners.filter("uncovered and low < high").drop("uncovered"), "shared")
    other = F.when(F.col("low") < F.col("id"), F.col("low")).otherwise(F.col("high"))
    looked_up = open_.filter("at is not null").drop("least_other").join(shared, "passage").withColumn("least_other", other)
    matches = matches.unionByName(looked_up.select(*fields))

    def places(at: pd.Series) -> pd.Series:
        return at.map(lambda b: np.frombuffer(b, "<i4").tolist())

    spans = matches.withColumn("p", F.explode(F.pandas_udf(places, "array<int>")("at")))
    spans = spans.select("id", (F.col("p") - F.col("before")).alias("start"), (F.col("p") + F.col("after")).alias("end"), "least_other")
    return _joined(spans, id_col)


def _joined(spans: DataFrame, id_col: str) -> DataFrame:
    """Spans of a document that overlap or touch, as one passage."""
    by_start = W.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("passage", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    whole = numbered.groupBy("id", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("least_other").alias("other"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return whole.select(
        known("id").alias(id_col), "start", "end", (F.col("end") - F.col("start")).alias("n_words"),
        known("other").alias("other_id"), (F.col("other") < F.col("id")).alias("later"),
    )
