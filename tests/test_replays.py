"""Streams of several triggers: files out of order, rows that come late, a query that is killed and goes on."""

import pytest
from conftest import duck, same_rows
from pyspark.sql import functions as F

from reelspan.plans import streams
from reelspan.registry import ORACLE_SQL
from reelspan.sources.tables import table
from reelspan.streaming import ingest, replays


def test_outer_waits_of_shuffled_files(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = replays.staged(events, F.pmod(F.xxhash64("event_id"), F.lit(20)))
    assert replays.disorder(spark, folder) > 20 * 86400
    rows, progress = replays.in_time(spark, folder), []
    kinds = [replays.only(rows, F.col("event_type") == kind) for kind in ("view", "purchase")]
    found = replays.run(replays.waits(*kinds, "user_id", "6 HOURS"), progress)
    same_rows(found, duck(sf), ORACLE_SQL["stream_outer_waits"])
    assert len(progress) >= 20 and not any(d for _, _, d in replays.dropped(progress))


def test_files_in_order_let_state_go(spark, sf):
    folder, progress = streams.staged(spark, sf), []
    assert replays.disorder(spark, folder) == 0
    rows = replays.in_time(spark, folder)
    replays.run(replays.sessions(rows, "user_id", "5 hours"), progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    total = spark.read.parquet(folder).count()
    assert max(held) < total / 2 and not any(d for _, _, d in replays.dropped(progress))


def test_late_rows_are_counted(spark, sf):
    folder, progress = replays.staged(streams.arrived(spark, sf), F.col("file"), close=None), []
    kept = replays.in_time_ids(replays.stream(spark, folder), "event_id", "20 DAYS", progress).count()
    total = table(spark, sf, "events").count()
    assert kept < total and sum(d for _, _, d in replays.dropped(progress)) == total - kept


def test_ingestion_goes_on_after_it_was_killed(spark, sf, tmp_path):
    folder, staged = str(tmp_path), streams.staged(spark, sf)
    rows = ingest.sightings(streams.items(spark, sf, staged), 60 * 86_400_000)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKS)
    write = ingest.fan_out(folder)

    def dies(batch, number):
        write(batch, number)
        if number == 3:
            raise RuntimeError("killed after its rows were written, before it was done")

    query = rows.writeStream.outputMode("append").foreachBatch(dies).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    ingest.start(rows, folder).awaitTermination()
    new = ingest.taken(spark, folder)
    found = new.select("id", F.lit("new").alias("event"), "event_id", F.lit(0).cast("long").alias("n"))
    ended = ingest.closed(spark, folder).select("id", F.lit("closed").alias("event"), F.lit(None).cast("long").alias("event_id"), F.col("sightings").alias("n"))
    same_rows(found.unionByName(ended), duck(sf), ORACLE_SQL["stream_ingestion"])
    seeds = new.collect()
    assert len({r.seed for r in seeds}) == len(seeds) and all(r.seed == r.batch * ingest.SEEDS + r.place for r in seeds)
