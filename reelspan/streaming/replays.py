"""Tables replayed as streams of several triggers, whose watermarks evict state and drop what comes late.

A staged table is a folder of files in the order in which the stream is to meet them: by a batch number.
The file source goes by modification times, so these are set in that order; where a store doesn't keep
them, the measured disorder grows and with it the delay, and results stay whole. The last two files are
rows with a far `ts` and nulls else: they move the watermark past everything, so that all state is closed at the end.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.sources.folders import scratch

#: Bytes of a row group of a staged file: a trigger's one file is read by several tasks.
ROW_GROUP = 4 << 20
#: State in RocksDB, whose commit writes what changed; an in-memory store keeps two versions of all state on the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state(spark: SparkSession) -> Iterator[None]:
    """Settings with which a stream with state is started; a query keeps those it started with.

    Every partition of the state costs a commit a trigger, whatever it holds, so there are two a core at most.
    """
    parts = "spark.sql.shuffle.partitions"
    settings = {**STATE, parts: str(min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(events: DataFrame, batch: Column, close: str | None = "100 DAYS") -> str:
    """Writes `events` (with a timestamp `ts`) as files in the order of `batch`; `close` is how far past the last `ts` the closing row lies."""
    spark = events.sparkSession
    folder = scratch(spark, f"staged-{uuid.uuid4().hex}")
    rows = events.withColumn("_batch", batch.cast("long"))
    rows.repartition("_batch").write.partitionBy("_batch").option("parquet.block.size", ROW_GROUP).parquet(folder)
    if close:
        ends = rows.agg(F.max("ts").alias("ts"), F.max("_batch").alias("_batch")).filter("ts IS NOT NULL")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
        # twice, since the mark that the first one sets holds from the next batch on
        last = ends.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2))))
        last = last.select((F.col("ts") + F.expr(f"INTERVAL {close}")).alias("ts"), *nulls, (F.col("_batch") + F.col("_n")).alias("_batch"))
        last.write.mode("append").partitionBy("_batch").parquet(folder)
    in_order(spark, folder)
    return folder


def in_order(spark: SparkSession, folder: str) -> None:
    """Gives the files of a staged folder modification times a second apart, by batch."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(conf)
    held = sorted((int(s.getPath().getName().partition("=")[2]), s.getPath()) for s in files.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName())
    start = int(time.time()) - len(held) - 60
    for n, (_, path) in enumerate(held):
        for s in files.listStatus(path):
            files.setTimes(s.getPath(), (start + n) * 1000, -1)


def disorder(spark: SparkSession, folder: str) -> int:
    """Seconds by which a row of a staged folder is older, at most, than another that comes in an earlier file; 0 where files are in order.

    One row a file is ordered, by modification time; files of the same time count as earlier than each other.
    """
    rows = spark.read.parquet(folder).select("ts", "_metadata.file_path", F.unix_millis("_metadata.file_modification_time").alias("at"))
    files = rows.groupBy("file_path", "at").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.orderBy("at")
    last = F.max("last")
    earlier = last.over(order.rangeBetween(Window.unboundedPreceding, -1))
    tied = F.when(F.count("*").over(Window.partitionBy("at")) > 1, last.over(order.rangeBetween(Window.unboundedPreceding, 0)))
    behind = files.select((F.unix_micros(F.coalesce(tied, earlier)) - F.unix_micros("first")).alias("m"))
    most = behind.agg(F.max("m")).first()[0]
    return max(0, -(-(most or 0) // 1_000_000))


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A staged folder as a stream, `files` files a trigger."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).drop("_batch")


def run(rows: DataFrame, progress: list | None = None) -> DataFrame:
    """Runs a stream in append mode over all that is there and returns its sink; `progress` gets what each trigger reported."""
    spark, out = rows.sparkSession, scratch(rows.sparkSession, f"stream-{uuid.uuid4().hex}")
    with state(spark):
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) for p in query.recentProgress]
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def in_time(spark: SparkSession, folder: str) -> DataFrame:
    """A staged folder as a stream whose watermark follows a second behind what its disorder allows, so that no row is late."""
    return stream(spark, folder).withWatermark("ts", f"{disorder(spark, folder) + 1} SECONDS")


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that fulfil a condition, after the watermark has seen all of them: a plain filter is moved below it, and closing rows would go unseen."""
    return rows.filter(F.coalesce(F.when(F.col("ts").isNotNull(), condition), F.lit(False)))


def waits(produced: DataFrame, consumed: DataFrame, key: str, bound: str) -> DataFrame:
    """Each produced row with all consumed rows of its key at most `bound` after it; without one it comes out with nulls.

    Both have event_id and ts, and are tables or streams with watermarks; a stream's row comes out with
    nulls when the watermark has passed its bound and its state is let go.
    """
    p, c = produced.alias("p"), consumed.alias("c")
    on = (F.col(f"p.{key}") == F.col(f"c.{key}")) & (F.col("c.ts") > F.col("p.ts")) & (F.col("c.ts") <= F.col("p.ts") + F.expr(f"INTERVAL {bound}"))
    wait = F.unix_micros("c.ts") - F.unix_micros("p.ts")
    return p.join(c, on, "left_outer").select(F.col(f"p.{key}").alias(key), F.col("p.event_id").alias("produced_id"), F.col("c.event_id").alias("consumed_id"), wait.alias("wait_micros"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key, rows less than `gap` apart; a stream needs a watermark, which closes them."""
    out = only(events, F.col(key).isNotNull()).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def in_time_ids(events: DataFrame, key: str, bound: str, progress: list | None = None) -> DataFrame:
    """Ids of a stream, each once, without the rows that come over `bound` late; `progress` tells how many those were."""
    return run(events.withWatermark("ts", bound).dropDuplicatesWithinWatermark([key]).select(key), progress)


def dropped(progress: list) -> list[tuple[int, int, int]]:
    """(batch, rows read, rows dropped as late) of each trigger that a stream reported."""
    return [(p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in progress]
