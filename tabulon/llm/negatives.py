"""Mine hard negatives with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. By
Cauchy and Schwarz no half in a codeword scores more with an anchor's half than the codeword itself
plus the norm of the anchor's half times the codeword's radius, so two such bounds together bound a
cell. A heap visits cells by falling bound (multi-sequence order) without looking at them all, and
an anchor stops once no cell left can reach any of its windows: what it has is then exact.

The index is dealt out in shards of whole cells (a large cell over several). An anchor is first
searched in the shard of its best cell; the scores found there decide which other shards it has to
be sent to, and go along as what must be beaten.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulon.llm.shared import stored

# Codewords of each half, the rows that their codebooks are fitted on, and rounds of the fit.
CODEWORDS, SAMPLE_ROWS, ROUNDS = 32, 20_000, 8
# Rows of a shard, anchors that meet a shard in one task, and rows scored at a time.
SHARD_ROWS, BLOCK_ANCHORS, CHUNK_ROWS = 32_768, 65_536, 2_048
FAR = 1 << 62


def fit_codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the rows of x: spread starts, then means. Empty centres keep their place."""
    x = np.unique(x, axis=0).astype(float) if x.shape[1] else np.zeros((min(len(x), 1), 0))
    rng = np.random.default_rng(0)
    centres = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]]
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest centre of each row, and the distance to it."""
    own = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


@dataclass
class Index:
    """What every task knows: codebooks, radii, and the cells with the shards that hold them."""

    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray  # rows (i, j, first shard, shards)
    radii: np.ndarray  # the cell's own radii in both halves
    wide: tuple[np.ndarray, np.ndarray]  # the largest radius of each codeword
    shards: int
    dim: int
    kind: str  # how a vector is stored
    largest: float  # norm

    @property
    def exact(self) -> type:
        """A type in which sums of products up to the largest squared norm have no rounding."""
        return np.float32 if self.largest**2 < 1 << 24 else np.float64 if self.largest**2 < 1 << 52 else np.int64

    def slack(self, anchor: np.ndarray) -> float:
        return 1e-9 * float(np.linalg.norm(anchor)) * self.largest + 1e-6

    def half_bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For both halves: scores of the codewords, and bounds on the scores of what lies in them."""
        half, a = self.books[0].shape[1], anchor.astype(float)
        one, two = self.books[0] @ a[:half], self.books[1] @ a[half:]
        return one, two, one + np.linalg.norm(a[:half]) * self.wide[0], two + np.linalg.norm(a[half:]) * self.wide[1]

    def cell_bounds(self, anchor: np.ndarray) -> np.ndarray:
        """Bound of every cell by its own radii."""
        half, a = self.books[0].shape[1], anchor.astype(float)
        one, two, _, _ = self.half_bounds(anchor)
        i, j = self.cells[:, 0], self.cells[:, 1]
        return one[i] + two[j] + np.linalg.norm(a[:half]) * self.radii[:, 0] + np.linalg.norm(a[half:]) * self.radii[:, 1]

    def vectors(self, column) -> np.ndarray:
        data = np.frombuffer(b"".join(column), self.kind)
        return data.reshape(len(column), self.dim)


@dataclass
class Task:
    """What one anchor looks for: the best ``n`` others of the same label, or of another, in each window (k, low, high, need)."""

    id: int
    label: int
    vector: np.ndarray
    windows: list[tuple[int, int, int, int]]


class Shard:
    """Rows of some cells, sorted by cell."""

    def __init__(self, index: Index, ids, labels, i, j, vectors: np.ndarray):
        order = np.lexsort((ids, j, i))
        self.index, self.ids, self.labels = index, np.asarray(ids)[order], np.asarray(labels)[order]
        self.x = np.ascontiguousarray(vectors[order].astype(index.exact))
        cell = np.stack([np.asarray(i)[order], np.asarray(j)[order]], axis=1)
        starts = np.append(0, np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1)
        ends = np.append(starts[1:], len(cell))
        self.places = {(a, b): (s, e) for (a, b), s, e in zip(cell[starts].tolist(), starts.tolist(), ends.tolist())}
        self.own = {(a, b): r for (a, b, *_), r in zip(index.cells.tolist(), index.radii.tolist()) if (a, b) in self.places}
        self.one, self.two = np.unique(cell[:, 0]), np.unique(cell[:, 1])

    def search(self, task: Task, same: bool, n: int) -> tuple[list[tuple[int, int, int]], int]:
        """(k, score, id) of the best rows found in each window, and how many rows were scored."""
        index, a = self.index, task.vector
        one, two, first, second = index.half_bounds(a)
        norms = [float(np.linalg.norm(h)) for h in np.split(a.astype(float), [index.books[0].shape[1]])]
        by_first, by_second = self.one[np.argsort(-first[self.one])], self.two[np.argsort(-second[self.two])]
        slack, vector = index.slack(a), a.astype(index.exact)
        best: list[list[tuple[int, int]]] = [[] for _ in task.windows]
        needs = [need for *_, need in task.windows]
        lowest, top = min(needs), max(w[2] for w in task.windows)
        ranges, held, scored = [], 0, 0

        def score() -> None:
            nonlocal held, scored, lowest
            if not held:
                return
            at = np.concatenate([np.arange(s, e) for s, e in ranges]) if len(ranges) > 1 else np.arange(*ranges[0])
            x = self.x[at] if len(ranges) > 1 else self.x[ranges[0][0] : ranges[0][1]]
            got = x @ vector
            some = (got >= lowest) & (got <= top) & ((self.labels[at] == task.label) == same) & (self.ids[at] != task.id)
            points, ids = got[some].astype(np.int64), self.ids[at[some]]
            if len(points):
                for w, (_, low, high, _) in enumerate(task.windows):
                    fits = np.flatnonzero((points >= max(low, needs[w])) & (points <= high))
                    if len(fits) > n:
                        fits = fits[np.lexsort((ids[fits], -points[fits]))[:n]]
                    if len(fits):
                        best[w] = sorted(best[w] + list(zip((-points[fits]).tolist(), ids[fits].tolist())))[:n]
                        if len(best[w]) == n:
                            needs[w] = max(needs[w], -best[w][-1][0])
                lowest = min(needs)
            scored += held
            ranges.clear()
            held = 0

        # The multi-sequence heap: a pair is pushed once the pair before it in either order has been met.
        heap, seen = [(-(first[by_first[0]] + second[by_second[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, p, q = heappop(heap)
            if slack - bound < lowest:
                break
            for r, s in ((p + 1, q), (p, q + 1)):
                if r < len(by_first) and s < len(by_second) and (r, s) not in seen:
                    seen.add((r, s))
                    heappush(heap, (-(first[by_first[r]] + second[by_second[s]]), r, s))
            cell = int(by_first[p]), int(by_second[q])
            if cell in self.places:
                i, j = cell
                radius = self.own[cell]
                if one[i] + two[j] + norms[0] * radius[0] + norms[1] * radius[1] + slack >= lowest:
                    ranges.append(self.places[cell])
                    held += ranges[-1][1] - ranges[-1][0]
                    if held >= CHUNK_ROWS:
                        score()
        score()
        return [(task.windows[w][0], -s, i) for w, found in enumerate(best) for s, i in found], scored


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of numbers; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


_INDEXED = "id long, label long, i int, j int, r1 double, r2 double, salt long, vec binary"


def _assign(books: tuple[np.ndarray, np.ndarray], dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = 0
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            half = books[0].shape[1]
            i, r1 = nearest(x[:, :half].astype(float), books[0])
            j, r2 = nearest(x[:, half:].astype(float), books[1])
            raw = np.ascontiguousarray(x.astype(kind))
            salt, met = np.arange(met, met + len(x)), met + len(x)
            columns = (
                batch.column(0), batch.column(1), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(r1), pa.array(r2),
                pa.array(salt, pa.int64()), pa.array([row.tobytes() for row in raw], pa.binary()),
            )
            yield pa.record_batch(list(columns), ["id", "label", "i", "j", "r1", "r2", "salt", "vec"])

    return run


def build_index(rows: DataFrame, codewords: int = CODEWORDS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[Index, DataFrame] | None:
    """The index of rows (id, label, vector), and its table; None without rows.

    Codebooks are fitted on the ``sample_rows`` rows of smallest id hash; every row is indexed.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    n, dim, top, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(largest), F.max(squares)).first()
    if not n:
        return None
    if norm2 >= FAR:
        raise ValueError("scores must fit a long")
    kind = "<i2" if (top or 0) < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    picked = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows).select("vector").collect()
    sample = np.zeros((len(picked), dim))
    for row, (v,) in zip(sample, picked):
        row[: len(v)] = v
    half = (dim + 1) // 2
    books = fit_codebook(sample[:, :half], codewords), fit_codebook(sample[:, half:], codewords)
    table = stored(rows.select("id", "label", "vector").mapInArrow(_assign(books, dim, kind), _INDEXED), "multi-index")
    # At most codewords^2 cells.
    counts = table.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("i", "j").collect()
    cells, shard, room = [], -1, 0
    for c in counts:
        over = math.ceil(c["n"] / shard_rows)
        if over > 1 or c["n"] > room:
            shard, room = shard + 1, shard_rows
        cells.append((c["i"], c["j"], shard, over))
        shard, room = shard + over - 1, room - c["n"] if over == 1 else 0
    cells, radii = np.array(cells, np.int64), np.array([(c["r1"], c["r2"]) for c in counts])
    wide = tuple(np.zeros(len(b)) for b in books)
    for h in (0, 1):
        np.maximum.at(wide[h], cells[:, h], radii[:, h])
    index = Index(books, cells, radii, wide, shard + 1, dim, kind, math.sqrt(norm2))
    places = rows.sparkSession.createDataFrame(cells.tolist(), "i int, j int, first long, over long")
    sharded = table.join(F.broadcast(places), ["i", "j"])
    return index, sharded.select("id", "label", "i", "j", "vec", (F.col("first") + F.pmod(F.xxhash64("salt"), F.col("over"))).cast("int").alias("shard"))


_WINDOWS = "array<struct<k:int,low:long,high:long,need:long>>"
_ASKED = f"id long, label long, vec binary, windows {_WINDOWS}"
_FOUND = "anchor long, k int, score long, other long"


def _requests(index: Index, home: bool):
    """Send an anchor to the shard of its best cell, or to all others that can hold something it needs."""

    first, over = index.cells[:, 2], index.cells[:, 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, shards = [], []
            for at, (vector, windows) in enumerate(zip(index.vectors(batch.column(2).to_pylist()), batch.column(3).to_pylist())):
                bounds = index.cell_bounds(vector)
                best = int(np.argmax(bounds))
                if home:
                    to = [int(first[best])]
                else:
                    need = min(w["need"] for w in windows)
                    live = np.flatnonzero(bounds + index.slack(vector) >= need)
                    to = sorted({s for c in live for s in range(first[c], first[c] + over[c])} - {int(first[best])})
                take += [at] * len(to)
                shards += to
            sent = pa.Table.from_batches([batch]).take(pa.array(take, pa.int64())).append_column("shard", pa.array(shards, pa.int32()))
            yield from sent.combine_chunks().to_batches()

    return run


def _visit(index: Index, same: bool, n: int):
    """Rows of each shard (kind 0), then the anchors that visit it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = np.append(0, np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1)
            for a, b in zip(marks.tolist(), [*marks[1:].tolist(), batch.num_rows]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, parts, shard = keys[a], [], None
                run_ = batch.slice(a, b - a)
                if kinds[a] == 0:
                    columns = [run_.column(c).to_numpy() for c in (2, 3, 4, 5)]
                    parts.append((*columns, index.vectors(run_.column(6).to_pylist())))
                    continue
                if shard is None and not parts:
                    continue
                if shard is None:
                    shard, parts = Shard(index, *[np.concatenate(c) for c in zip(*parts)]), []
                out: list[tuple] = []
                vectors = index.vectors(run_.column(6).to_pylist())
                for id, label, vector, windows in zip(run_.column(2).to_pylist(), run_.column(3).to_pylist(), vectors, run_.column(7).to_pylist()):
                    task = Task(id, label, vector, [(w["k"], w["low"], w["high"], w["need"]) for w in windows])
                    out += [(id, *found) for found in shard.search(task, same, n)[0]]
                if out:
                    kinds_ = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], ["anchor", "k", "score", "other"])

    return run


def _best(found: DataFrame, n: int) -> DataFrame:
    """The first n of each anchor and window, numbered from 1. A group holds n rows per shard at most."""
    order = W.partitionBy("anchor", "k").orderBy(F.desc("score"), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def search(index: Index, table: DataFrame, asked: DataFrame, same: bool, n: int, blocks: int) -> DataFrame:
    """anchor, k, score, other, place: the best n rows of the same label, or of others, in each window of ``asked``."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = table.withColumn("block", each) if blocks > 1 else table.withColumn("block", F.lit(0))
    rows = rows.select(
        (F.col("shard") * blocks + F.col("block")).alias("key"), F.lit(0).alias("kind"), "id", "label", "i", "j", "vec", F.lit(None).cast(_WINDOWS).alias("windows")
    )

    def visit(asked: DataFrame, home: bool) -> DataFrame:
        sent = asked.select("id", "label", "vec", "windows").mapInArrow(_requests(index, home), _ASKED + ", shard int")
        none = F.lit(None).cast("int")
        sent = sent.select(
            (F.col("shard") * blocks + block).alias("key"), F.lit(1).alias("kind"), "id", "label", none.alias("i"), none.alias("j"), "vec", "windows"
        )
        # So many partitions that few shards meet in one; a stated number is not merged by size, since few bytes make much work here.
        tasks = max(2, 2 * index.shards * blocks)
        met = rows.unionByName(sent).repartition(tasks, "key").sortWithinPartitions("key", "kind")
        return met.mapInArrow(_visit(index, same, n), _FOUND)

    home = stored(_best(visit(asked, True), n), "home", compact=True)
    if index.shards == 1:
        return home
    full = home.groupBy(F.col("anchor").alias("id"), "k").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("have")).filter(F.col("have") == n)
    one = asked.select("id", F.explode("windows").alias("w")).select("id", "w.*").join(full, ["id", "k"], "left")
    needs = one.groupBy("id").agg(F.collect_list(F.struct("k", "low", "high", F.greatest("need", F.coalesce("last", "need")).alias("need"))).alias("windows"))
    carried = asked.drop("windows").join(needs, "id")
    rest = visit(carried, False)
    return stored(_best(home.drop("place").unionByName(rest), n), "found", compact=True)


def hard_negatives(
    rows: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    codewords: int = CODEWORDS,
    sample_rows: int = SAMPLE_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id (long), label (long) and vector (array of whole numbers); scores are inner
    products, higher first, ties by smaller id. Anchors are the rows whose id ``every`` divides. An
    anchor's positives are its first ``positives`` other rows of the same label; for each, the
    negatives are the first rows of other labels that score at most as much and at least
    ``percent`` of a hundred of it. Results are exact.

    Rows with a null id, label, vector or component take no part. Shorter vectors count as ending in
    zeros, so an empty one scores 0. Other rows are those with another id; of an anchor id that is
    repeated the least row (label, then vector) is the anchor, while repeated rows all count as
    positives and negatives. A negative positive score leaves an empty window. An anchor without
    positives or negatives has no rows; an empty table gives none. Other columns are not read.
    """
    spark = rows.sparkSession
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>")).filter(known)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = build_index(rows, codewords, sample_rows, shard_rows)
    if built is None:
        return spark.createDataFrame([], out)
    index, table = built
    anchors = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.*")
    anchors = stored(anchors.mapInArrow(_assign(index.books, index.dim, index.kind), _INDEXED).select("id", "label", "vec"), "anchors", compact=True)
    blocks = max(1, math.ceil(anchors.count() / BLOCK_ANCHORS))
    everything = F.array(F.struct(F.lit(0).alias("k"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"), F.lit(-FAR).alias("need")))
    close = search(index, table, anchors.withColumn("windows", everything), True, positives, blocks)
    # Whole numbers s with percent * p <= 100 * s <= 100 * p.
    low = F.expr(f"(score div 100) * {percent}L + ((score % 100) * {percent}L + 99L) div 100L")
    window = F.struct(F.col("place").alias("k"), low.alias("low"), F.col("score").alias("high"), low.alias("need"))
    windows = close.filter("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_list(window).alias("windows"))
    hard = search(index, table, anchors.join(windows, "id"), False, negatives, blocks)
    mined = hard.withColumnsRenamed({"score": "negative_score", "other": "negative_id", "place": "rank"}).join(
        close.select("anchor", F.col("place").alias("k"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "k"]
    )
    return mined.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
