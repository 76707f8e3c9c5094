"""Streaming forms of batch operators: windows, sessions, running rates and deduplication.

Each takes a streaming DataFrame and returns one. ``run_to_table`` drives a query over what is
available and leaves its output as parquet in the shared folder, with its progress kept there too.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.plans.shared import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` may be a folder, a pattern or one file."""
    # Written as a pattern, since the source takes a plain path for a folder.
    pattern = path if any(ch in path for ch in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)


def _timed(sdf: DataFrame, ts: str, late: str) -> DataFrame:
    # A watermark needs a timestamp with a time zone; files hold one without.
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_tumbling(sdf: DataFrame, ts: str, by: Sequence[str], c: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean per key in fixed windows."""
    g = _timed(sdf, ts, late).groupBy(F.window(ts, width), *by)
    return g.agg(F.count("*").alias("n"), F.avg(c).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean")


def stream_sliding(sdf: DataFrame, ts: str, c: str, width: str = "7 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean over overlapping windows."""
    g = _timed(sdf, ts, late).groupBy(F.window(ts, width, step))
    return g.agg(F.count("*").alias("n"), F.avg(c).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def stream_sessions(sdf: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per user session, a session ending after a gap without rows."""
    g = _timed(sdf, ts, late).groupBy(F.session_window(ts, gap).alias("s"), user)
    return g.agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stream_ctr(sdf: DataFrame, arm: str, click: str) -> DataFrame:
    """Impressions, clicks and rate per arm so far, kept in state.

    A built-in aggregate: a micro-batch is summed in every task before it meets the state, so one
    busy arm costs the state one row per task. Use update mode.
    """
    g = sdf.groupBy(arm).agg(F.count("*").alias("shown"), F.sum(click).cast("long").alias("clicks"))
    return g.withColumn("ctr", F.col("clicks") / F.col("shown"))


def stream_dedup(sdf: DataFrame, ts: str, key: Sequence[str], late: str = "1 hour") -> DataFrame:
    """First row per key; keys are forgotten, and rows dropped, once the watermark has passed them."""
    return _timed(sdf, ts, late).dropDuplicatesWithinWatermark(list(key))


def run_to_table(sdf: DataFrame, name: str) -> DataFrame:
    """Run an append-mode query over all available files and return its output table."""
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def run_complete(sdf: DataFrame, name: str) -> DataFrame:
    """Run a query over all available files and return its whole result, open windows and sessions included."""
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = sdf.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    # Every micro-batch writes the whole result so far; the last one stands.
    return rows.filter(F.col("batch") == rows.select(F.max("batch")).scalar()).drop("batch")


def run_updates(sdf: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Run an update-mode query, keep every micro-batch's changed rows, and return the last per key."""
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")

    def keep(batch: DataFrame, epoch: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = sdf.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    value = F.struct(*[c for c in rows.columns if c not in (*key, "batch")])
    return rows.groupBy(*key).agg(F.max_by(value, "batch").alias("v")).select(*key, "v.*")


