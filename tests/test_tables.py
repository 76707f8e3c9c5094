"""User aggregates merged in trees, and table functions."""

import json
import random

import pytest

from tabulon.functions import tables as tb


@pytest.mark.parametrize("fan_in,held", [(32, 50_000), (2, 50_000), (2, 3)])
def test_states_are_merged_in_a_tree(spark, monkeypatch, fan_in, held):
    monkeypatch.setattr(tb, "HELD_KEYS", held)

    def bottom(state, rows):
        """The three smallest distinct numbers, as a sketch of distinct values would keep them."""
        old = set() if state is None else set(json.loads(state))
        return json.dumps(sorted(old | set(rows["x"].tolist()))[:3]).encode()

    rng = random.Random(fan_in)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice(["a", None]), rng.randint(0, 60)) for _ in range(900)]
    rows += [(1, "a", i) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "k int, s string, x long").repartition(11)
    merge = lambda a, b: json.dumps(sorted(set(json.loads(a)) | set(json.loads(b)))[:3]).encode()
    out = tb.merged_states(df, ["k", "s"], bottom, merge, lambda s: list(enumerate(json.loads(s))), "place int, x long", fan_in)
    assert out.dtypes == [("k", "int"), ("s", "string"), ("place", "int"), ("x", "bigint")]
    groups = {}
    for k, s, x in rows:
        groups.setdefault((k, s), set()).add(x)
    want = {(k, s, i, x) for (k, s), xs in groups.items() for i, x in enumerate(sorted(xs)[:3])}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert tb.merged_states(df.limit(0), ["k"], bottom, merge, lambda s: [], "x long").count() == 0


def test_ordered_partitions_pass_row_by_row(spark):
    class Gaps:
        def __init__(self):
            self.last, self.n = None, 0

        def eval(self, row):
            if self.last is not None:
                yield row["k"], row["x"] - self.last
            self.last, self.n = row["x"], self.n + 1

        def terminate(self):
            yield -1, self.n

    tb.register_table_function(spark, "gaps", Gaps, "k long, gap long")
    df = spark.createDataFrame([(k, x * x) for k in (1, 2) for x in range(5)] + [(3, 7)], "k long, x long").repartition(4)
    rows = spark.sql("select * from gaps(table(select * from {df}) partition by k order by x)", df=df).collect()
    assert sorted(map(tuple, rows)) == sorted([(k, g) for k in (1, 2) for g in (1, 3, 5, 7)] + [(-1, 5), (-1, 5), (-1, 1)])
