"""Streams with state of their own: running rates per key with expiry, and late rows counted from query progress."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabulon.plans.shared import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningRate(StatefulProcessor):
    """Impressions and clicks of an arm so far. An arm that stays idle is reported once more and forgotten."""

    def __init__(self, arm: str, ttl_ms: int, idle_ms: int):
        self.arm, self.ttl_ms, self.idle_ms = arm, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "shown long, clicks long", self.ttl_ms or None)

    def _row(self, key, shown: int, clicks: int, idle: bool) -> pd.DataFrame:
        return pd.DataFrame({self.arm: [key[0]], "shown": [shown], "clicks": [clicks], "ctr": [clicks / shown], "idle": [idle]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        shown, clicks = self.total.get() if self.total.exists() else (0, 0)
        last = 0
        for b in rows:
            shown, clicks = shown + int(b["shown"].sum()), clicks + int(b["clicks"].sum())
            last = max(last, int(b["ts"].max().timestamp() * 1000)) if self.idle_ms else 0
        self.total.update((shown, clicks))
        if self.idle_ms:
            # One timer per arm: earlier ones give way to the latest.
            timers = list(self.handle.listTimers())
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max([last + self.idle_ms, *timers]))
        yield self._row(key, shown, clicks, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.total.exists():
            shown, clicks = self.total.get()
            self.total.clear()
            yield self._row(key, shown, clicks, True)

    def close(self) -> None:
        pass


def stream_ctr_state(
    sdf: DataFrame, arm: str, click: str, ts: str | None = None, late: str = "1 hour", idle_ms: int = 0, ttl_ms: int = 0
) -> DataFrame:
    """arm, shown, clicks, ctr, idle: running rate per arm in keyed state; use update mode.

    Tasks add up their rows first, so a busy arm brings its state one row per task and batch. With
    ``idle_ms`` an arm for which the watermark has come so far past its last ``ts`` gives a last row
    (idle) and starts anew; what a task adds up counts as late by its latest time. With ``ttl_ms`` a
    state that has not been written for so long, by the clock, is dropped silently; such a query
    never runs out of batches, so run it with ``once``.
    """
    if idle_ms and ttl_ms:
        raise ValueError("idle_ms goes by event time and ttl_ms by the clock: give one of them")
    kind = dict(sdf.dtypes)[arm]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b.groupby("arm", dropna=False).agg(shown=("click", "size"), clicks=("click", "sum"), ts=("ts", "max")).reset_index()
            yield pd.DataFrame({arm: g["arm"], "shown": g["shown"], "clicks": g["clicks"].astype("int64"), "ts": g["ts"]})

    at = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    rows = sdf.select(F.col(arm).alias("arm"), F.coalesce(F.col(click).cast("long"), F.lit(0)).alias("click"), at.alias("ts"))
    sums = rows.mapInPandas(partial, f"`{arm}` {kind}, shown long, clicks long, ts timestamp")
    mode = "EventTime" if idle_ms else "ProcessingTime" if ttl_ms else "None"
    sums = sums.withWatermark("ts", late) if idle_ms else sums
    out = f"`{arm}` {kind}, shown long, clicks long, ctr double, idle boolean"
    return sums.groupBy(arm).transformWithStateInPandas(RunningRate(arm, ttl_ms, idle_ms), out, "Update", mode)


def run_state_updates(sdf: DataFrame, out: str, progress: str, once: bool = False) -> DataFrame:
    """Run an update-mode query with keyed state over all available files; all rows it has ever sent, with their batch.

    The same folders go on where an earlier run stopped, within a batch too: a batch's rows replace
    what an interrupted attempt at it has left. ``once`` takes all files as a single batch.
    """
    spark = sdf.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    spark.conf.set(key, ROCKSDB)
    try:
        writer = sdf.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", progress)
        (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(out)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row per key of a table with batches."""
    value = F.struct(*[c for c in rows.columns if c not in (key, "batch")])
    return rows.groupBy(key).agg(F.max_by(value, "batch").alias("v")).select(key, "v.*")


# Progress reports that are kept while a counted query runs: one per micro-batch.
REPORTS = 100_000


def run_counting_late(sdf: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Run an append-mode query over all available files: its output table, and the rows dropped as later than the watermark."""
    spark = sdf.sparkSession
    out, progress = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(REPORTS))
    try:
        q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(sdf.schema).parquet(out), dropped
