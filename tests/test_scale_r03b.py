"""What findings F12, F18, F19 and F22 of the third round asked for, on small tables made here."""

from collections import Counter
from itertools import combinations

import pytest

from tabulon.operators import baskets as bk, recommend as rc


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


BASKETS = [(1, "abc"), (2, "abc"), (3, "cab"), (4, "bd"), (5, "abd"), (6, "e"), (7, "abcd"), (8, "db"), (None, "ab")]


@pytest.mark.parametrize("subsets", [16, 0])
def test_itemsets_are_those_of_all_subsets(spark, monkeypatch, subsets):
    monkeypatch.setattr(bk, "SUBSETS", subsets)
    df = spark.createDataFrame([(b, i) for b, items in BASKETS for i in items * 2], "b long, i string").repartition(3)
    want = Counter(s for _, items in BASKETS for n in range(1, 5) for s in combinations(sorted(items), n))
    got = {tuple(r["items"]): (r["freq"], r["support"]) for r in bk.frequent_itemsets(df, "b", "i", 0.25).collect()}
    assert got == {s: (n, n / 8) for s, n in want.items() if n >= 2}


def test_equal_baskets_are_counted_together(spark, monkeypatch):
    def grown(**_):
        raise AssertionError("a tree was grown for every basket")

    monkeypatch.setattr(bk, "FPGrowth", grown)
    df = spark.createDataFrame([(b, i) for b in range(60) for i in ("abc" if b % 2 else "bcd")], "b long, i string")
    assert {"".join(r["items"]): r["freq"] for r in bk.frequent_itemsets(df, "b", "i", 0.9).collect()} == {"b": 60, "c": 60, "bc": 60}


def test_baskets_are_made_distinct_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b"), (3, "a"), (None, "b")], "b long, i string")
    out = bk.filter_baskets(df, "b", "i")
    assert "ExistingRDD" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


@pytest.mark.parametrize("group_rows", [None, 2])
def test_negatives_read_their_edges_once(spark, group_rows):
    seen = {1: [10, 12], 2: [10, 11, 12, 13, 14], 3: [14], 4: [11, 12, 13, 14]}
    edges = spark.createDataFrame([(u, i) for u, items in seen.items() for i in items * 2], "user long, item long").repartition(3)
    items = spark.createDataFrame([(i,) for i in range(10, 15)], "item long")
    out = rc.sample_negatives(edges, items, 7, group_rows=group_rows)
    assert "ExistingRDD" not in _plan(out)
    rows = out.collect()
    # A user who has seen everything gets no row.
    assert sorted((r["user"], r["item"]) for r in rows) == sorted((u, i) for u in (1, 3, 4) for i in seen[u])
    assert all(r["negative"] not in seen[r["user"]] and 10 <= r["negative"] < 15 for r in rows)
    asked = edges.distinct().select("user", "item", rc.hashed(["user", "item"], 7).alias("h")).collect()
    free = {u: [i for i in range(10, 15) if i not in s] for u, s in seen.items()}
    want = {(r["user"], r["item"]): free[r["user"]][r["h"] % len(free[r["user"]])] for r in asked if free[r["user"]]}
    assert {(r["user"], r["item"]): r["negative"] for r in rows} == want
