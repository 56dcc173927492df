"""Queries over staged replays: streams of several triggers whose watermarks let state go, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.plans.queries import query
from reelspan.sources.folders import scratch
from reelspan.sources.tables import table
from reelspan.streaming import ingest, replays, sessions

DAYS = 4


def staged(spark, sf: str, *columns: str) -> str:
    """`events` (of its columns these, if any are named) as files of four days each, in the order of time."""
    events = table(spark, sf, "events").select(*columns or "*").withColumn("ts", F.col("ts").cast("timestamp"))
    return replays.staged(events, F.floor(F.unix_seconds("ts") / (DAYS * 86400)))


@query("""SELECT p.user_id, p.event_id AS produced_id, c.event_id AS consumed_id, epoch_us(c.ts) - epoch_us(p.ts) AS wait_micros
FROM (SELECT * FROM events WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c
ON p.user_id = c.user_id AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL '6 hours'""")
def stream_outer_waits(spark, sf):
    """Every view with the purchases of its user within six hours, and those without one, as state is let go."""
    rows = replays.in_time(spark, staged(spark, sf))
    return replays.run(replays.waits(*[replays.only(rows, F.col("event_type") == kind) for kind in ("view", "purchase")], "user_id", "6 HOURS"))


@query("""SELECT job.event_id AS job_id, result.event_id AS result_id, epoch_us(result.ts) - epoch_us(job.ts) AS wait_micros
FROM (SELECT * FROM events WHERE event_type = 'signup') job LEFT JOIN (SELECT event_id + 7 AS job_id, event_id, ts FROM events WHERE event_type IN ('click', 'purchase')) result
ON result.job_id = job.event_id AND result.ts > job.ts - INTERVAL '2 days' AND result.ts <= job.ts + INTERVAL '2 days'""")
def stream_job_results(spark, sf):
    """Enqueued jobs with the result that names them, null for jobs without one."""
    rows = replays.in_time(spark, staged(spark, sf))
    jobs = replays.only(rows, F.col("event_type") == "signup").alias("job")
    results = replays.only(rows, F.col("event_type").isin("click", "purchase")).select((F.col("event_id") + 7).alias("job_id"), "event_id", "ts").alias("result")
    near = F.expr("result.job_id = job.event_id AND result.ts > job.ts - INTERVAL 2 DAYS AND result.ts <= job.ts + INTERVAL 2 DAYS")
    wait = F.unix_micros("result.ts") - F.unix_micros("job.ts")
    return replays.run(jobs.join(results, near, "left_outer").select(F.col("job.event_id").alias("job_id"), F.col("result.event_id").alias("result_id"), wait.alias("wait_micros")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '5 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '5 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf):
    """Sessions, each once, when the watermark has closed it."""
    rows = replays.in_time(spark, staged(spark, sf, "user_id", "ts"))
    out = replays.run(sessions.bucketed(rows, "user_id", "5 hours"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def arrived(spark, sf: str) -> DataFrame:
    """Events that arrive in sixteen files of a drawn order, long after each other's time."""
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 1), 16, 10).cast("long").alias("file"))


@query("""WITH a AS (SELECT event_id, epoch_us(ts) AS us, ('0x' || substr(md5(event_id::VARCHAR), 1, 1))::BIGINT AS file FROM events),
f AS (SELECT file, max(us) // 1000 * 1000 AS latest FROM a GROUP BY file),
w AS (SELECT file, max(latest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 20 * 86400000000 AS mark FROM f)
SELECT event_id FROM a JOIN w USING (file) WHERE mark IS NULL OR us > mark""")
def stream_late_audit(spark, sf):
    """Events that a watermark of twenty days lets through; late rows are judged by the mark that the batch before started with."""
    folder = replays.staged(arrived(spark, sf), F.col("file"), close=None)
    return replays.in_time_ids(replays.stream(spark, folder), "event_id", "20 DAYS")


def items(spark, sf: str, folder: str) -> DataFrame:
    """Users as items, which an error resets."""
    rows = replays.only(replays.in_time(spark, folder), F.col("user_id").isNotNull())
    return rows.select(F.col("user_id").alias("id"), "event_id", "ts", (F.col("event_type") == "error").alias("reset"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS cut FROM events)
SELECT user_id AS id, 'new' AS event, event_id, 0::BIGINT AS n FROM e WHERE event_type <> 'error' AND (before IS NULL OR before = 'error')
UNION ALL SELECT user_id, 'closed', NULL, count(*) FROM e WHERE cut IS NULL OR ts > cut GROUP BY user_id""")
def stream_ingestion(spark, sf):
    """Items as they are new, or new again after a reset, and how often each was seen before it was closed."""
    folder = scratch(spark, f"ingestion-{uuid.uuid4().hex}")
    ingest.start(ingest.sightings(items(spark, sf, staged(spark, sf)), 60 * 86_400_000), folder).awaitTermination()
    new = ingest.taken(spark, folder).select("id", F.lit("new").alias("event"), "event_id", F.lit(0).cast("long").alias("n"))
    return new.unionByName(ingest.closed(spark, folder).select("id", F.lit("closed").alias("event"), F.lit(None).cast("long").alias("event_id"), F.col("sightings").alias("n")))
