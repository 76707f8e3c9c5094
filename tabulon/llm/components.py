"""Connected components of a link table, without collecting a component anywhere."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.shared import stored


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as stars around the smallest node of each piece."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.array([x for x, up in parent.items() if x != up], dtype=np.int64)
    tops = np.array([root(int(x)) for x in nodes], dtype=np.int64)
    for i in range(0, len(nodes), 65_536):
        yield pa.record_batch({"a": nodes[i : i + 65_536], "b": tops[i : i + 65_536]})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Nodes get the smallest of their neighbours by an aggregate that is partial in each task."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # In the large step greater neighbours move to the smallest; in the small one lesser ones and the node do.
    moved = both.filter("b > a") if large else both
    out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star steps; each is written in the shared folder. A node
    without a link to another has no row. The number of steps grows with the logarithm of the
    number of nodes.
    """
    pieces = links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = stored(pieces.mapInArrow(_contract, "a long, b long"), "links")
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
