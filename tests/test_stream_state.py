"""State of the staged streams: items in buckets with their timers, few partitions in RocksDB, files read in parts."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reelspan.plans import streams
from reelspan.streaming import ingest, replays


def ingested(spark, folder, rows):
    """Rows of an ingestion of a staged folder, and what its triggers reported."""
    query = ingest.start(rows, folder)
    query.awaitTermination()
    new = sorted((r.id, r.event_id) for r in ingest.taken(spark, folder).collect())
    return new, sorted((r.id, r.sightings) for r in ingest.closed(spark, folder).collect()), query.recentProgress


def test_items_of_a_bucket_share_a_key_and_keep_their_own_timers(spark, tmp_path):
    # (id, day, reset): item 1 runs out in a batch that brings rows of item 2, which shares its bucket
    seen = [(1, 0, False), (1, 0, False), (2, 0, False), (-5, 0, False), (300, 0, False), (2, 50, False), (2, 70, False), (2, 71, False), (1, 100, False), (2, 101, True), (2, 102, False), (300, 102, True)]
    rows = [(n, item, day, reset) for n, (item, day, reset) in enumerate(seen)]
    df = spark.createDataFrame(rows, "event_id long, id long, day long, reset boolean").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    staged = replays.staged(df, F.col("day"))
    items = replays.only(replays.in_time(spark, staged), F.col("id").isNotNull()).select("id", "event_id", "ts", "reset")
    new, closed, progress = ingested(spark, str(tmp_path), ingest.sightings(items, 60 * 86_400_000))
    assert new == [(-5, 3), (1, 0), (1, 8), (2, 2), (2, 10), (300, 4)]
    assert closed == [(-5, 1), (1, 1), (1, 2), (2, 1), (300, 1)]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) == 3


def test_streams_with_state_commit_few_partitions_to_rocksdb(spark, sf):
    before = {k: spark.conf.get(k, None) for k in (*replays.STATE, "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        progress = []
        rows = replays.in_time(spark, streams.staged(spark, sf))
        replays.run(replays.sessions(rows, "user_id", "5 hours"), progress)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    held = progress[1]["stateOperators"][0]
    assert held["numShufflePartitions"] == 2 * spark.sparkContext.defaultParallelism
    assert any(k.startswith("rocksdb") for k in held["customMetrics"])
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_a_staged_file_is_read_in_several_parts(spark):
    rows = spark.range(600_000).select("id", F.timestamp_seconds("id").alias("ts"), F.md5(F.col("id").cast("string")).alias("m"))
    folder = replays.staged(rows, F.lit(0))
    files = glob.glob(f"{folder.removeprefix('file:')}/_batch=0/*.parquet")
    assert len(files) == 1 and pq.ParquetFile(files[0]).metadata.num_row_groups > 2
