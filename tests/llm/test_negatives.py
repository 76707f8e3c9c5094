"""Hard negatives against scores of all pairs."""

import numpy as np
import pytest

from tabulon.llm import negatives as hn
from tabulon.llm.queries import op11

SCHEMA = "id long, label long, vector array<long>, vec string, shard string, k string, score string"


def brute(rows, every=100, n=5, percent=80):
    rows = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v]
    anchors = {}
    for i, y, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    dot = lambda a, b: sum(x * z for x, z in zip(a, b))
    out = []
    for a, (label, vec) in anchors.items():
        scored = [(-dot(vec, v), i, y == label) for i, y, v in rows if i != a]
        close = sorted((s, i) for s, i, same in scored if same)[:n]
        far = sorted((s, i) for s, i, same in scored if not same)
        for s, p in close:
            fits = [(t, i) for t, i in far if percent * -s <= 100 * -t <= 100 * -s][:n]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(rng, n, dim, spread, labels=4, scale=60):
    centres = rng.normal(size=(12, dim))
    x = np.floor((centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))) * scale).astype(int)
    return [(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(rng.integers(0, labels, n), x))]


@pytest.mark.parametrize("dim,spread,codewords,shard_rows", [(16, 0.3, 6, 100), (7, 1.5, 4, 37), (1, 1.0, 3, 10_000), (24, 0.05, 8, 60)])
def test_against_all_pairs(spark, dim, spread, codewords, shard_rows):
    rows = clustered(np.random.default_rng(dim), 700, dim, spread)
    # Half of all rows are one vector, so a cell is dealt over many shards, and scores tie.
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(600)]
    want = brute(rows, every=50)
    assert len(want) > 50
    assert mined(spark, rows, every=50, codewords=codewords, shard_rows=shard_rows, sample_rows=150) == want


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 9)
    rows = clustered(np.random.default_rng(2), 400, 8, 0.5)
    assert mined(spark, rows, every=10, codewords=4, shard_rows=90) == brute(rows, every=10)


def test_awkward_rows(spark):
    rows = clustered(np.random.default_rng(3), 120, 6, 0.6)
    rows += [(None, 1, [1] * 6), (900, None, [1] * 6), (901, 1, None), (902, 1, [1, None]), (903, 1, []), (904, 0, [5, 5]), (905, 0, [0] * 6)]
    # An anchor id with two rows, a repeated row, a negative id, and large numbers.
    rows += [(100, 3, [9] * 6), (100, 2, [7] * 6), (906, 1, rows[3][2]), (906, 1, rows[3][2]), (-100, 0, [-50, 40, 3, 2, 1, 0])]
    assert mined(spark, rows, every=20, codewords=3, shard_rows=30) == brute(rows, every=20)
    for scale in (40_000, 3_000_000_00):
        big = [(i, y, v if v is None else [x if x is None else x * scale // 60 for x in v]) for i, y, v in rows]
        assert mined(spark, big, every=20, codewords=3, shard_rows=30) == brute(big, every=20)
    assert mined(spark, [], every=20) == [] and mined(spark, [(1, 1, [1])]) == [] and mined(spark, [(0, 1, [1])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 32])])


def test_bounds_skip_rows():
    """Tight clusters: an anchor's search ends long before all rows are scored, and finds the same."""
    rng = np.random.default_rng(5)
    rows = clustered(rng, 20_000, 16, 0.03, scale=1000)
    x = np.array([v for *_, v in rows])
    books = hn.fit_codebook(x[:3000, :8], 16), hn.fit_codebook(x[:3000, 8:], 16)
    (i, r1), (j, r2) = hn.nearest(x[:, :8], books[0]), hn.nearest(x[:, 8:], books[1])
    cells = np.unique(np.stack([i, j], axis=1), axis=0)
    radii = np.array([(r1[(i == a) & (j == b)].max(), r2[(i == a) & (j == b)].max()) for a, b in cells])
    wide = tuple(np.array([max([r[k] for c, r in zip(cells, radii) if c[k] == w], default=0) for w in range(16)]) for k in (0, 1))
    index = hn.Index(books, np.hstack([cells, np.zeros_like(cells)]), radii, wide, 1, 16, "<i4", float(np.linalg.norm(x, axis=1).max()))
    labels = np.array([y for _, y, _ in rows])
    shard = hn.Shard(index, np.arange(len(x)), labels, i, j, x)
    for a in range(0, 2000, 100):
        found, scored = shard.search(hn.Task(a, labels[a], x[a], [(0, -hn.FAR, hn.FAR, -hn.FAR)]), True, 5)
        same = [(-int(s), k) for k, s in enumerate(x @ x[a]) if labels[k] == labels[a] and k != a]
        assert [(-s, k) for _, s, k in found] == sorted(same)[:5]
        assert scored < len(x) / 3


def test_query_on_awkward_columns(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.1 * i, 1.0 - i], i % 2) for i in range(-3, 12)] + [(100, [1.0, nan], 1), (200, [inf, 0.0], 1), (300, None, 1), (400, [1.0, None], 0), (None, [1.0, 1.0], 1), (500, [1.0, 2.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, y in rows[:15]]
    assert sorted(tuple(r) for r in op11(spark, str(tmp_path)).collect()) == brute(plain)
