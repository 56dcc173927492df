"""Ingestion that takes each item once: state by item, in buckets, with counts, resets and timers, fanned out by batch.

A stream of (id, event_id, ts, reset) gives a row `new` when an item is met first, or first after a reset, and a row
`closed` with its number of sightings once its timer has run out. Batches go to folders of their own, so
a batch that is replayed after a failure writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reelspan.operators.draws import draw
from reelspan.operators.lookup import rank_by
from reelspan.streaming.replays import STATE, state

OUTPUT = "id long, event string, event_id long, sightings long"
ROCKS = STATE["spark.sql.streaming.stateStore.providerClass"]
#: Ids that share all but so many lowest bits share a key of the state, which holds 256 items at most.
BUCKET_BITS = 8
#: Seeds of a batch begin at its number times this.
SEEDS = 100_000


class Sightings(StatefulProcessor):
    """Sightings of the items of a bucket since they were new; rows of a batch count in the order of (ts, event_id).

    A key costs several calls to the state store and data frames of its own, so the items of a bucket share one:
    their state is one value, their rows are computed together, and one timer stands for the first that runs out.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "id array<long>, n array<long>, until array<long>, timer long")

    def _get(self) -> tuple[pd.DataFrame, int | None]:
        """n and until of the items held, by id, and the bucket's timer."""
        found = self.held.get()
        *columns, timer = found if found is not None else ([], [], [], None)
        ids, n, until = (np.array(c, np.int64) for c in columns)
        return pd.DataFrame({"n": n, "until": until}, index=ids), timer

    def _keep(self, items: pd.DataFrame, timer: int | None) -> None:
        """Keeps the items; the timer goes to where the first of them runs out."""
        first = int(items["until"].min()) if len(items) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.held.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.held.update((items.index.tolist(), items["n"].tolist(), items["until"].tolist(), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(["id", "us", "event_id"])
        held, timer = self._get()
        ids, at, sizes = np.unique(own["id"].to_numpy(np.int64), return_index=True, return_counts=True)
        reset, ends = own["reset"].to_numpy(bool), at + sizes - 1
        known = held.reindex(ids, fill_value=0)
        after = np.append(False, reset[:-1])  # after a reset, or as its item's first row without a count
        after[at] = known["n"] == 0
        fresh = own[after & ~reset]
        cuts = np.cumsum(reset)
        counted = np.add.reduceat(((cuts == np.repeat(cuts[ends], sizes)) & ~reset).astype(np.int64), at)
        n = counted + np.where(np.logical_or.reduceat(reset, at), 0, known["n"])
        until = np.maximum(own["us"].to_numpy(np.int64)[ends] // 1000 + self.idle_ms, np.where(n > counted, known["until"], 0))
        seen = pd.DataFrame({"n": n, "until": until}, index=ids)
        self._keep(pd.concat([held[~held.index.isin(ids)], seen[seen["n"] > 0]]), timer)
        if len(fresh):
            yield pd.DataFrame({"id": fresh["id"].to_numpy(np.int64), "event": "new", "event_id": fresh["event_id"].to_numpy(np.int64), "sightings": 0})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, timer = self._get()
        due = (held["until"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())).to_numpy()
        self._keep(held[~due], timer)
        if due.any():
            yield pd.DataFrame({"id": held.index[due], "event": "closed", "event_id": pd.Series([None] * due.sum(), dtype="Int64"), "sightings": held["n"].to_numpy()[due]})

    def close(self) -> None:
        pass


def sightings(items: DataFrame, idle_ms: int) -> DataFrame:
    """The rows of items, from a stream with a watermark on `ts`."""
    rows = items.select(F.shiftright("id", BUCKET_BITS).alias("bucket"), "id", "event_id", F.unix_micros("ts").alias("us"), "reset")
    return rows.groupBy("bucket").transformWithStateInPandas(Sightings(idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def fan_out(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's new items with their places and seeds, and its closed ones, each in the batch's folder."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        fresh = batch.filter("event = 'new'").select("id", "event_id").withColumn("_g", F.lit(0))
        placed = rank_by(fresh.withColumn("_at", draw(0, F.col("id"), F.col("event_id"))), "_g", "_at", "event_id", "place").drop("_g", "_at")
        placed.withColumn("seed", F.col("place") + number * SEEDS).write.mode("overwrite").parquet(f"{folder}/new/batch={number}")
        batch.filter("event = 'closed'").select("id", "sightings").write.mode("overwrite").parquet(f"{folder}/closed/batch={number}")
        batch.unpersist()

    return run


def start(rows: DataFrame, folder: str):
    """Starts the ingestion of all that is there; with the same folder it goes on from where it stopped."""
    with state(rows.sparkSession):
        return rows.writeStream.outputMode("append").foreachBatch(fan_out(folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """id, event_id, place, seed and batch of all items taken."""
    return spark.read.schema("id long, event_id long, place long, seed long, batch long").parquet(f"{folder}/new")


def closed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id long, sightings long, batch long").parquet(f"{folder}/closed")
