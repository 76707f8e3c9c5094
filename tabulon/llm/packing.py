"""Pack documents into as few token sequences as can be, best fit by bulk steps.

Pieces are sorted by range over (length, document), so that pieces of one length are numbered
across tasks without meeting in one. Lengths and gaps are whole numbers up to the capacity, so all
pieces of a length, and all sequences with the same gap and history, move as one run: a sweep
takes the next shorter run of pieces, finds the successor among the gaps for the whole run,
settles which piece goes where by rank, and updates the gaps. What a sweep decides holds for
ranks, not rows: the tasks then look their pieces up.
"""

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulon.llm.shared import small_batches, stored, text_of
from tabulon.llm.tokens import ids_of

CAPACITY, END = 2048, 0
# Rows of the plan that may be broadcast: under 64 bytes each. A plan has a few rows per length.
PLAN_ROWS = 1_000_000
_PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """One row per piece. A document is its ids and ``end``; only the first piece may be shorter."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(ids_of(path, text), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    row.append(n)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at = stop
            yield pa.record_batch({
                "id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            })

    return rows.mapInArrow(cut, _PIECES.format(id=kind.simpleString()))


class _Gaps:
    """Runs of sequences by gap: first sequence and how many, oldest first."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, deque] = defaultdict(deque)

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.runs[gap]:
                insort(self.sizes, gap)
            self.runs[gap].append((first, count))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Take the run with the smallest gap that holds ``length``."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.runs[gap].popleft()
        if not self.runs[gap]:
            self.sizes.pop(at)
        return gap, first, count


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces per sequence, first sequence, offset) by best fit decreasing.

    The pieces of a length with ranks first..last go to consecutive sequences, so many to each, one
    after another from the offset. Equal to best fit one piece at a time, longest first: the piece
    after a piece of the same length goes behind it while it fits, as no gap that holds it is smaller.
    """
    plan, gaps, opened = [], _Gaps(), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            run = gaps.successor(length)
            if run is None:
                each = capacity // length
                run = (capacity, opened, -(-left // each))
                opened += run[2]
            gap, first, count = run
            each = gap // length
            used = min(count, left // each)
            if used:
                plan.append((length, rank, rank + used * each - 1, each, first, capacity - gap))
                gaps.add(gap - each * length, first, used)
                rank, left, first, count = rank + used * each, left - used * each, first + used, count - used
            if left and count and left < each:
                plan.append((length, rank, rank + left - 1, left, first, capacity - gap))
                gaps.add(gap - left * length, first, 1)
                left, first, count = 0, first + 1, count - 1
            # Sequences that have taken nothing stay as they were.
            gaps.add(gap, first, count)
    return plan


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with ``rank`` 0, 1, .. among those of their length, however many have the same length."""
    spread = stored(pieces, "pieces", compact=True)
    # Equal rows are told apart by where they were written.
    spread = spread.withColumn("row", F.monotonically_increasing_id())
    # Sorted by range; ids and row numbers split a common length over many tasks.
    ordered = spread.orderBy(F.col("length").desc(), F.col("id"), "piece", "row").drop("row")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("part", "length", "first", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ordered.join(counts, ["part", "length"])
    return placed.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every text is encoded whole without added tokens and ends with ``end``. Only documents longer
    than ``capacity`` are cut, into pieces of that length with the shorter one first. Null and empty
    texts are the single id ``end``; repeated rows are packed each; null ids are kept; no documents
    give no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    ranked = stored(numbered(cut_pieces(docs, path, id_col, text_col, capacity, end)), "ranked")
    # At most one row per length up to the capacity.
    sizes = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = best_fit_plan(sizes, capacity)
    if len(rows) > PLAN_ROWS:
        raise ValueError("the plan is too long to be sent to every task")
    plan = spark.createDataFrame(rows or [(0,) * 6], "length long, low long, high long, each long, first long, base long")
    joined = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("low"), F.col("high"))).drop(plan["length"])
    step = F.col("rank") - F.col("low")
    return joined.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("base") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
