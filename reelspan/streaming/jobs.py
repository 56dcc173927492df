"""Event streams: tumbling and sliding reports, sessions, exactly-once ids, producer-consumer waits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.sources.folders import scratch


def replay(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream with a timestamp column `ts`.

    All files come in one batch of an availableNow run: files may be in any order of time, and a
    watermark set by an earlier batch would drop rows of later ones as late. With `files` a batch has
    that many files at most, for streams without a watermark.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    # as a pattern, a stream's path may be one file as well as a folder of files
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    rows = reader.parquet(f"{folder}/{{{name}}}")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet sink, and returns the sink as a table."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, f"stream-{uuid.uuid4().hex}")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def updated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream to its end; the last state of each key."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, f"stream-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    names = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("_r")).select(*keys, "_r.*")


def throughput(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and mean value of each type by window, tumbling or sliding."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Episodes of a user: events less than `gap` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(stream: DataFrame, key: str, late: str = "40 days") -> DataFrame:
    """Each id once, as it first comes."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def unprocessed(stream: DataFrame, done: DataFrame, key: Column) -> DataFrame:
    """Rows of a stream (or a table) whose key isn't in the column `id` of `done`, as it is when a batch starts."""
    held = done.select(F.col("id").alias("_id")).distinct()
    return stream.withColumn("_id", key).join(held, "_id", "left_anti").drop("_id")


def waits(produced: DataFrame, consumed: DataFrame, key: str, bound: str) -> DataFrame:
    """Pairs of produced and consumed rows of a key, the second within `bound` after the first."""
    p, c = produced.withWatermark("ts", bound).alias("p"), consumed.withWatermark("ts", bound).alias("c")
    on = (F.col(f"p.{key}") == F.col(f"c.{key}")) & (F.col("c.ts") > F.col("p.ts")) & (F.col("c.ts") <= F.col("p.ts") + F.expr(f"INTERVAL {bound}"))
    return p.join(c, on).select(F.col(f"p.{key}").alias(key), F.col("p.event_id").alias("produced_id"), F.col("c.event_id").alias("consumed_id"))


def with_failure_budget(budget: int, failed: str, folder: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that ends the query once over `budget` rows failed.

    Counts are kept by batch in `folder` (a new one if none is given): a replayed batch writes its count
    again, and a query that starts again with the same folder goes on from what it had.
    """
    kept = {"folder": folder}

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept["folder"] = kept["folder"] or scratch(spark, f"failures-{uuid.uuid4().hex}")
        batch.filter(failed).agg(F.count("*").alias("failed")).write.mode("overwrite").parquet(f"{kept['folder']}/batch={number}")
        total = spark.read.parquet(kept["folder"]).agg(F.sum("failed")).first()[0]
        if total > budget:
            raise RuntimeError(f"{total} rows failed by batch {number}; the budget is {budget}")

    return run


def next_waits(events: DataFrame, key: str, produced: Column, consumed: Column) -> DataFrame:
    """Each produced row of a table with the first consumed row of its key after it; null where none comes.

    `events` has event_id and ts. One ordered pass over a key's rows, no pairs.
    """
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    then = F.last(F.when(consumed, F.struct("event_id", "ts")), ignorenulls=True).over(w)
    rows = events.withColumn("_then", then).filter(produced)
    wait = F.unix_micros("_then.ts") - F.unix_micros("ts")
    return rows.select(key, F.col("event_id").alias("produced_id"), F.col("_then.event_id").alias("consumed_id"), wait.alias("wait_micros"))


def completion(events: DataFrame, worker: str, ready: Column, done: Column) -> DataFrame:
    """By worker: rows that became ready, rows done, those still open, and whether none is."""
    out = events.groupBy(worker).agg(F.count_if(ready).alias("ready"), F.count_if(done).alias("done"))
    return out.withColumn("open", F.greatest(F.col("ready") - F.col("done"), F.lit(0))).withColumn("finished", F.col("done") >= F.col("ready"))


def late_rows(events: DataFrame, arrival: str, bucket: Column, bound: str) -> DataFrame:
    """Rows a watermark of `bound` would drop: those over `bound` older than the latest `ts` that arrived before them.

    `bucket` is a coarse form of `arrival`: a bucket is read in order by one task, its largest `ts`
    carried over from the buckets before.
    """
    rows = events.withColumn("_b", bucket)
    own = rows.groupBy("_b").agg(F.max("ts").alias("_max"))
    before = own.withColumn("_before", F.max("_max").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_max")  # a row a bucket
    inside = Window.partitionBy("_b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_in", F.max("ts").over(inside)).join(before, "_b")
    latest = F.greatest("_in", "_before")  # the one that isn't null, if one is
    return seen.withColumn("latest", latest).filter(F.col("ts") < F.col("latest") - F.expr(f"INTERVAL {bound}")).drop("_b", "_in", "_before")
