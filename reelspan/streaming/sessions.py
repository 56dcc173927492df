"""Sessions of a stream with the state of many keys in one value: as `replays.sessions` gives them, at a fraction of its state's cost.

A session window keeps a row of state a session, looked up twice for every key of a trigger and read through to close what is due.
Here keys that share all but their lowest bits share a key of the state: their open sessions are arrays in one value, and the rows of
a trigger are merged into them together. What a task holds is the open sessions of one bucket and one batch of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reelspan.streaming.replays import only

#: Keys that share all but so many lowest bits share a key of the state.
BUCKET_BITS = 8


def merged(spans: np.ndarray, gap: int) -> np.ndarray:
    """Spans (rows id, first, last, n) of an id that lie less than `gap` apart as one; in order of (id, first)."""
    if not spans.shape[1]:
        return spans
    ids, first, last, n = spans[:, np.lexsort((spans[1], spans[0]))]
    reach = pd.Series(last).groupby(ids, sort=False).cummax().to_numpy()
    at = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (first[1:] - reach[:-1] >= gap)))
    return np.stack([ids[at], first[at], np.maximum.reduceat(last, at), np.add.reduceat(n, at)])


class Sessions(StatefulProcessor):
    """Open sessions of a bucket's keys; one timer stands for the first that ends. A late row, if there is one, is a session of its own."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "spans binary, timer long")

    def _get(self) -> tuple[np.ndarray, int | None]:
        packed, timer = self.held.get() or (b"", None)
        return np.frombuffer(bytes(packed), np.int64).reshape(4, -1), timer

    def _closed(self, spans: np.ndarray, timer: int | None, mark: int) -> Iterator[pd.DataFrame]:
        """Keeps what ends after the mark (milliseconds; 0: there is none yet) and gives out the rest."""
        ends = spans[2] + self.gap
        due = (ends <= mark * 1000) & (mark > 0)
        first = None if due.all() else int(-(-ends[~due].min() // 1000))
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.held.clear()
        else:
            if timer != first:
                self.handle.registerTimer(first)
            self.held.update((spans[:, ~due].tobytes(), first))
        if due.any():
            yield pd.DataFrame({"id": spans[0, due], "first": spans[1, due], "end": ends[due], "n": spans[3, due]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans, timer = self._get()
        for own in rows:
            us = own["us"].to_numpy(np.int64)
            spans = merged(np.hstack([spans, [own["id"].to_numpy(np.int64), us, us, np.ones_like(us)]]), self.gap)
        yield from self._closed(spans, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans, timer = self._get()
        yield from self._closed(spans, timer, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def bucketed(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a whole-number key of a stream with a watermark on `ts`, rows less than `gap` apart: key, session_start, session_end, n."""
    micros = events.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))).first()[0]
    rows = only(events, F.col(key).isNotNull()).select(F.shiftright(key, BUCKET_BITS).alias("bucket"), F.col(key).cast("long").alias("id"), F.unix_micros("ts").alias("us"))
    out = rows.groupBy("bucket").transformWithStateInPandas(Sessions(micros), outputStructType="id long, first long, end long, n long", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("id").alias(key), F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("end").alias("session_end"), "n")
