"""Keyed state: restarts, expiry, and late rows."""

import time
from datetime import datetime, timedelta

import pytest

from tabulon.streaming import state, twins

SCHEMA = "arm string, click int, ts timestamp"


def add(spark, path, rows, hour=0):
    rows = [(*r, datetime(2024, 1, 1) + timedelta(hours=hour)) for r in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, progress, once=False, **how):
    from pyspark.sql.types import _parse_datatype_string

    sdf = twins.read_stream(spark, f"{path}/*.parquet", _parse_datatype_string(SCHEMA), 1)
    rows = state.run_state_updates(state.stream_ctr_state(sdf, "arm", "click", **how), out, progress, once)
    return sorted((r["batch"], r["arm"] or "", r["shown"], r["clicks"], r["idle"]) for r in rows.collect())


PARTS = [[("a", 1), ("a", 0), ("b", 1)], [("a", 1), (None, 1)], [("b", 0), ("b", None), ("c", 0)]]
SENT = [("a", 2, 1), ("b", 1, 1), ("", 1, 1), ("a", 3, 2), ("b", 3, 1), ("c", 1, 0)]


def test_restart_in_the_middle_gives_the_same_rows(spark, tmp_path):
    whole, halves = str(tmp_path / "whole"), str(tmp_path / "halves")
    for part in PARTS:
        add(spark, whole, part)
    once = run(spark, whole, f"{tmp_path}/o1", f"{tmp_path}/p1")
    assert sorted(r[1:4] for r in once) == sorted(SENT)
    # The second run knows the first one only by its folders.
    add(spark, halves, PARTS[0])
    run(spark, halves, f"{tmp_path}/o2", f"{tmp_path}/p2")
    for part in PARTS[1:]:
        add(spark, halves, part)
    twice = run(spark, halves, f"{tmp_path}/o2", f"{tmp_path}/p2")
    assert [r[1:] for r in sorted(twice)] == [r[1:] for r in sorted(once)]
    assert {r["arm"]: r["shown"] for r in state.latest(spark.read.parquet(f"{tmp_path}/o2"), "arm").collect()} == {"a": 3, "b": 3, None: 1, "c": 1}


def test_idle_arms_expire(spark, tmp_path):
    """The watermark passes an hour after arm a's last row: a says good-bye, and starts anew when it is back."""
    path, folders = str(tmp_path / "in"), (f"{tmp_path}/out", f"{tmp_path}/progress")
    how = {"ts": "ts", "late": "1 minute", "idle_ms": 3_600_000}
    add(spark, path, [("a", 1), ("a", 1), ("b", 0)])
    run(spark, path, *folders, **how)
    add(spark, path, [("b", 1)], hour=0.5)
    assert not any(r[-1] for r in run(spark, path, *folders, **how))
    add(spark, path, [("c", 1)], hour=1.2)
    run(spark, path, *folders, **how)
    add(spark, path, [("a", 0)], hour=1.3)
    rows = [r[1:] for r in run(spark, path, *folders, **how)]
    assert sorted(rows) == sorted([("a", 2, 2, False), ("b", 1, 0, False), ("b", 2, 1, False), ("c", 1, 1, False), ("a", 2, 2, True), ("a", 1, 0, False)])


def test_states_outlive_their_time_only_when_written(spark, tmp_path):
    path, folders = str(tmp_path / "in"), (f"{tmp_path}/out", f"{tmp_path}/progress")
    add(spark, path, [("a", 1), ("a", 1), ("b", 0)])
    run(spark, path, *folders, once=True, ttl_ms=2_000)
    time.sleep(3)
    add(spark, path, [("a", 0)])
    rows = [r[1:] for r in run(spark, path, *folders, once=True, ttl_ms=2_000)]
    assert ("a", 1, 0, False) in rows and ("a", 3, 2, False) not in rows
    with pytest.raises(ValueError, match="give one"):
        run(spark, path, *folders, ts="ts", idle_ms=1, ttl_ms=1)
