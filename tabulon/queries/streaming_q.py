from pyspark.sql import functions as F

from tabulon.queries.registry import R, query, rnd, table
from tabulon.plans.shared import scratch_path
from tabulon.streaming import twins as st
from tabulon.streaming.state import latest, run_counting_late, run_state_updates, stream_ctr_state


def _events(spark, sf):
    return st.read_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Append mode gives the windows that the watermark (latest time less one hour) has passed.
CLOSED = "(select max(ts) - interval 1 hour from events)"


@query(
    "g01_stream_tumbling",
    f"""select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, {R('avg(value)')} as mean from events
    where date_trunc('day', ts) + interval 1 day <= {CLOSED} group by 1, 2""",
)
def _(spark, sf):
    out = st.run_to_table(st.stream_tumbling(_events(spark, sf), "ts", ["event_type"], "value"), "tumbling")
    return out.select(_stamp("start"), "event_type", "n", rnd("mean").alias("mean"))


@query(
    "g02_stream_sliding",
    f"""with w as (select date_trunc('day', ts) - to_days(cast(k as integer)) as start, value from events, range(7) t(k))
    select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {R('avg(value)')} as mean from w where start + interval 7 day <= {CLOSED} group by 1""",
)
def _(spark, sf):
    out = st.run_to_table(st.stream_sliding(_events(spark, sf), "ts", "value"), "sliding")
    return out.select(_stamp("start"), "n", rnd("mean").alias("mean"))


@query(
    "g03_stream_sessions",
    f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s having max(ts) + interval 30 minute <= {CLOSED}""",
)
def _(spark, sf):
    out = st.run_to_table(st.stream_sessions(_events(spark, sf), "ts", "user_id"), "sessions")
    return out.select("user_id", _stamp("start"), "n")


@query(
    "g01_stream_tumbling_all",
    f"""select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, {R('avg(value)')} as mean from events group by 1, 2""",
)
def _(spark, sf):
    """Update mode: windows still open at the end are there, too."""
    out = st.run_updates(st.stream_tumbling(_events(spark, sf), "ts", ["event_type"], "value"), "tumbling", ["start", "event_type"])
    return out.select(_stamp("start"), "event_type", "n", rnd("mean").alias("mean"))


@query(
    "g02_stream_sliding_all",
    f"""with w as (select date_trunc('day', ts) - to_days(cast(k as integer)) as start, value from events, range(7) t(k))
    select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {R('avg(value)')} as mean from w group by 1""",
)
def _(spark, sf):
    out = st.run_updates(st.stream_sliding(_events(spark, sf), "ts", "value"), "sliding", ["start"])
    return out.select(_stamp("start"), "n", rnd("mean").alias("mean"))


@query(
    "g03_stream_sessions_all",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s""",
)
def _(spark, sf):
    out = st.run_complete(st.stream_sessions(_events(spark, sf), "ts", "user_id"), "sessions")
    return out.select("user_id", _stamp("start"), "n")


@query(
    "g04_stream_running_ctr",
    f"""select user_id % 2 as arm, count(*) as shown, cast(count(*) filter (event_type = 'click') as bigint) as clicks,
    {R("count(*) filter (event_type = 'click') / count(*)")} as ctr from events group by 1""",
)
def _(spark, sf):
    log = _events(spark, sf).select((F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "click").cast("int").alias("click"))
    return st.run_updates(st.stream_ctr(log, "arm", "click"), "ctr", ["arm"]).withColumn("ctr", rnd("ctr"))


@query("g05_stream_dedup", "select event_id, user_id, event_type, value from events")
def _(spark, sf):
    twice = _events(spark, sf).unionByName(_events(spark, sf))
    out = st.run_to_table(st.stream_dedup(twice, "ts", ["event_id"]), "dedup")
    return out.select("event_id", "user_id", "event_type", "value")


@query(
    "g04_stream_ctr_state",
    f"""select user_id % 2 as arm, count(*) as shown, cast(count(*) filter (event_type = 'click') as bigint) as clicks,
    {R("count(*) filter (event_type = 'click') / count(*)")} as ctr, false as idle from events group by 1""",
)
def _(spark, sf):
    """The log in three parts of files, each a micro-batch, with arms that expire after 60 days without rows."""
    log = table(spark, sf, "events").select((F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "click").cast("int").alias("click"), "ts", (F.col("event_id") % 3).alias("part"))
    path = scratch_path(spark, "log")
    for part in range(3):
        log.filter(F.col("part") == part).drop("part").repartition(2).write.mode("append").parquet(path)
    sdf = st.read_stream(spark, f"{path}/*.parquet", log.drop("part").schema, 2)
    rows = stream_ctr_state(sdf, "arm", "click", "ts", "30 days", 60 * 24 * 3600 * 1000)
    rows = run_state_updates(rows, scratch_path(spark, "ctr"), scratch_path(spark, "ctr-progress"))
    return latest(rows, "arm").withColumn("ctr", rnd("ctr"))


# The events come in three batches. What counts as late in a batch is what lies behind the watermark
# with which the batch before it began: for the third, the latest time of the first less one hour,
# in milliseconds.
LATE = """with mark as (select date_trunc('millisecond', max(ts)) - interval 1 hour as mark from events where event_id % 3 = 1),
e as (select events.*, event_id % 3 = 0 and ts <= mark as late from events, mark) """


def _in_three_batches(spark, sf):
    events = table(spark, sf, "events")
    path = scratch_path(spark, "events")
    for part in (1, 2, 0):
        events.filter(F.col("event_id") % 3 == part).repartition(4).write.mode("append").parquet(path)
    sdf = st.read_stream(spark, f"{path}/*.parquet", events.schema, 4)
    return run_counting_late(st.stream_dedup(sdf, "ts", ["event_id"]), "late")


@query("g05_stream_dedup_late", LATE + "select event_id, user_id, event_type, value from e where not late")
def _(spark, sf):
    return _in_three_batches(spark, sf)[0].select("event_id", "user_id", "event_type", "value")


@query("g05_late_rows", LATE + "select count(*) filter (not late) as kept, count(*) filter (late) as dropped from e")
def _(spark, sf):
    out, dropped = _in_three_batches(spark, sf)
    return out.agg(F.count("*").alias("kept")).withColumn("dropped", F.lit(dropped).cast("long"))
