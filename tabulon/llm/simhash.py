"""Near copies by fingerprints that differ in few bits.

Fingerprints are cut into a ring of segments. If two differ in at most d bits over d + 1 segments,
then from some segment on every chain of l consecutive segments differs in at most l - 1 bits: the
first not at all, the first two in one bit at most, and so on. So candidates share one segment
and, as the next differs in one bit at most, one half of the next; the longer chains prune them
before the full count of bits.
"""

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.components import components
from tabulon.llm.shared import null_safe, runs, small_batches, stored, text_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
# Words hashed at a time, whatever the length of the text.
BLOCK_WORDS = 100_000
# Beyond this many bytes the words of a text are not held as a list.
LONG_TEXT = 4_000_000
# A bucket of more fingerprints is cut into blocks of this many, and every two blocks meet.
BUCKET = 8_192
# Buckets up to this many fingerprints are compared as shifted arrays.
SMALL = 12


def _bit_counts(words: list[bytes], size: int) -> np.ndarray:
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)))) if size > 1 else iter(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 bits of a text in UTF-8; a bit is set if it is set in over half of the hashes of the word shingles, repeats included."""
    # Of bytes only A-Z are lower-cased, and the blanks that split are those of ASCII.
    text = text.lower()
    words = iter(text.split()) if len(text) <= LONG_TEXT else (m.group() for m in WORD.finditer(text))
    block = list(islice(words, BLOCK_WORDS))
    if not block:
        return 0
    if len(block) <= size:
        n, counts = 1, _bit_counts([b" ".join(block)], 1)
    else:
        n, counts = len(block) - size + 1, _bit_counts(block, size)
        while len(block) >= BLOCK_WORDS and (more := list(islice(words, BLOCK_WORDS))):
            # The last words of a block begin shingles that end in the next.
            block = block[len(block) - size + 1 :] + more
            n, counts = n + len(more), counts + _bit_counts(block, size)
            if len(more) < BLOCK_WORDS:
                break
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3, *more: Column) -> DataFrame:
    """id and fp, a signed 64-bit number, for every row, and what more is asked for."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(text_of(text_col).cast("binary")).alias("fp"), *more)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _field(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _bucket_keys(max_bits: int) -> Column:
    """Two keys per segment: its number, its bits, and the bits of one half of the next segment."""
    ring, fp, keys = _segments(max_bits), F.col("fp"), []
    for i, (first, width) in enumerate(ring):
        after, more = ring[(i + 1) % len(ring)]
        if len(ring) == 1:
            return F.array(fp)
        for h, (start, size) in enumerate(((after, more // 2), (after + more // 2, more - more // 2))):
            bits = F.shiftleft(_field(fp, first, width), size).bitwiseOR(_field(fp, start, size))
            keys.append(F.shiftleft(F.lit(2 * i + h).cast("long"), 58).bitwiseOR(bits))
    return F.array(*keys)


def _chain_masks(max_bits: int) -> list[list[np.uint64]]:
    """For each segment the bits of the chains of 2, 3, .. segments that begin with it."""
    ring = [np.uint64(((1 << w) - 1) << a) for a, w in _segments(max_bits)]
    out = []
    for i in range(len(ring)):
        mask, masks = ring[i], []
        for step in range(1, len(ring)):
            mask = mask | ring[(i + step) % len(ring)]
            masks.append(mask)
        out.append(masks)
    return out


def _linked(diff: np.ndarray, masks: list[np.uint64]) -> np.ndarray:
    """Positions of differences that keep every chain within its budget; the last chain is the whole ring."""
    at = np.arange(len(diff))
    for budget, mask in enumerate(masks, 1):
        at = at[np.bitwise_count(diff[at] & mask) <= budget]
    return at


def _forest(fps: np.ndarray, masks: list[np.uint64]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked within one bucket: at most one less than its fingerprints."""
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _linked(rest ^ x, masks)
            if len(near):
                yield np.full(len(near), x), rest[near]
                front.extend(rest[near])
                rest = np.delete(rest, near)


def _bucket_links(max_bits: int):
    all_masks = _chain_masks(max_bits)

    def links(keys: np.ndarray, cells: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        spans = np.array(list(runs(keys, cells)), dtype=np.int64).reshape(-1, 2)
        size = spans[:, 1] - spans[:, 0]
        segment = (keys.view(np.uint64) >> np.uint64(59)).astype(np.int64)
        small = np.repeat(size <= SMALL, size)
        end = np.repeat(spans[:, 1], size)
        for shift in range(1, SMALL):
            at = np.flatnonzero(small & (np.arange(len(keys)) + shift < end))
            if not len(at):
                break
            for i, masks in enumerate(all_masks):
                own = at[segment[at] == i]
                hit = own[_linked(fps[own] ^ fps[own + shift], masks)]
                if len(hit):
                    yield fps[hit], fps[hit + shift]
        for a, b in spans[size > SMALL]:
            yield from _forest(fps[a:b], all_masks[segment[a]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(parts):
            for a, b in parts:
                yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            rows = [np.concatenate(p) for p in zip(held, new)]
            if not len(rows[0]):
                continue
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield from out(links(rows[0][:cut], rows[1][:cut], rows[2][:cut].view(np.uint64)))
        if len(held[0]):
            yield from out(links(held[0], held[1], held[2].view(np.uint64)))

    return run


def near_links(fps: DataFrame, max_bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``max_bits`` apart.

    Not every pair: within a bucket a spanning forest, which leaves the components as they are. A
    bucket with more than ``bucket`` fingerprints is cut into blocks by hash and every two blocks
    meet in one task, so that no task holds more than about two blocks.
    """
    keyed = fps.select("fp", F.explode(_bucket_keys(max_bits)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Blocks meet pairwise; the pair of own block and another has the same name from either side.
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
            lambda o: F.least(o, F.col("own")).cast("long") * F.col("blocks") + F.greatest(o, F.col("own")),
        )
    )
    placed = keyed.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
    placed = placed.select("key", F.explode(cells).alias("cell"), "fp")
    dealt = placed.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_bucket_links(max_bits), "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3, bucket: int = BUCKET
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    A-Z are lower-cased, words are runs without ASCII blanks, shingles have ``size`` words; fewer
    words make one shingle. Null, empty and blank texts have fingerprint zero and link like any
    other. Null ids are kept and count as no id; repeated rows are one node. Equal fingerprints are
    one node, so copies are never paired. An empty table gives no rows.
    """
    found = _members(docs, id_col, text_col, size, max_bits, bucket, [])
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(docs: DataFrame, id_col: str, text_col: str, size: int, max_bits: int, bucket: int, more: list[Column]) -> DataFrame:
    """id, fp and component_id for every row; where more columns are asked for, these and a name of the component."""
    small_batches(docs.sparkSession)
    fps = stored(fingerprints(docs, id_col, text_col, size, *more), "fingerprints", compact=True)
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    linked = components(near_links(nodes, max_bits, bucket))
    members = linked.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least")
    labels = members.groupBy("root").agg(F.min("least").alias("component_id"))
    root = ["root"] if more else []
    joined = members.join(labels, "root").select(F.col("fp").alias("_fp"), "component_id", *root)
    named = [F.coalesce("root", "fp").alias("component")] if more else []
    every = nodes.join(joined, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "least").alias("component_id"), *named)
    # Written, so that the join below has plain shuffles on both sides and a hot fingerprint can be split.
    every = stored(every, "labels")
    return fps.join(every, F.col("fp") == F.col("_fp")).drop("_fp")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one in every component.

    It is the one with the smallest id; rows without id come last. Rows are known by their id and a
    64-bit mark of their text. Of several texts with that id the one with the smallest mark stays,
    and of rows with that id and text any one.
    """
    mark = F.xxhash64(text_of(text_col))
    found = _members(docs, id_col, text_col, size, max_bits, BUCKET, [mark.alias("mark")])
    found = found.select("component", F.col("id").alias("_gone"), "mark", F.col("id").eqNullSafe(F.col("component_id")).alias("first"))
    # More rows than one with the id that stays; mostly there are none.
    firsts = found.filter("first")
    ties = firsts.groupBy("component").agg(F.min("mark").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tied = firsts.join(stored(ties, "ties"), "component").groupBy("_gone", "mark", "keep").agg(F.count(F.lit(1)).alias("n"))
    tied = stored(tied, "tied")
    gone = found.filter("not first").select("_gone", "mark").distinct()
    gone = stored(gone.unionByName(tied.filter("mark <> keep").select("_gone", "mark")), "near-copies")
    repeated = tied.filter("mark = keep and n > 1").select("_gone", "mark")

    def among(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(rows, null_safe(docs, rows, {id_col: "_gone"}) & (mark == rows["mark"]), how)

    if repeated.isEmpty():
        return among(gone, "left_anti")
    # Any one of equal rows: an aggregate that is partial in each task.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = among(repeated, "left_semi").groupBy(F.col(id_col), mark).agg(F.first(whole).alias("_row")).select("_row.*")
    return among(gone.unionByName(repeated), "left_anti").unionByName(one)
