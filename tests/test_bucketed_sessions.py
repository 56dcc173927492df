"""Sessions whose state is shared by the keys of a bucket: as session windows give them, with few rows of state."""

import numpy as np
from conftest import duck, same_rows
from pyspark.sql import functions as F

from reelspan.plans import streams
from reelspan.registry import ORACLE_SQL
from reelspan.streaming import replays, sessions


def test_spans_merge_up_to_the_gap():
    spans = np.array([(2, 0, 0, 1), (1, 20, 20, 1), (1, 0, 0, 1), (1, 9, 9, 1), (1, 30, 30, 1), (-7, 5, 100, 3), (-7, 50, 50, 1), (-7, 109, 109, 1)], np.int64).T
    assert sessions.merged(spans, 10).T.tolist() == [[-7, 5, 109, 5], [1, 0, 9, 2], [1, 20, 20, 1], [1, 30, 30, 1], [2, 0, 0, 1]]
    assert sessions.merged(spans[:, :0], 10).shape == (4, 0)


def test_sessions_cross_triggers_and_the_first_years(spark):
    # (user, hours): before 1970, over three files, a gap of exactly five hours, a bucket of its own, a negative key, a null
    seen = [(1, -60), (1, -56), (1, -20), (2, 10), (2, 14), (2, 18), (2, 23), (3, 10), (300, 30), (-1, 30), (None, 12), (1, 30), (1, 30)]
    df = spark.createDataFrame([(u, h) for u, h in seen], "user_id long, h long").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).drop("h")
    rows = replays.in_time(spark, replays.staged(df, F.floor(F.unix_seconds("ts") / (12 * 3600))))
    progress = []
    out = replays.run(sessions.bucketed(rows, "user_id", "5 hours"), progress)
    hours = lambda c: (F.unix_seconds(c) / 3600).cast("long")
    found = sorted(tuple(r) for r in out.select("user_id", hours("session_start"), hours("session_end"), "n").collect())
    assert found == [(-1, 30, 35, 1), (1, -60, -51, 2), (1, -20, -15, 1), (1, 30, 35, 2), (2, 10, 23, 3), (2, 23, 28, 1), (3, 10, 15, 1), (300, 30, 35, 1)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_stream_sessions_keeps_a_row_of_state_a_bucket(spark, sf, monkeypatch):
    progress, run = [], replays.run
    monkeypatch.setattr(replays, "run", lambda rows: run(rows, progress))
    same_rows(streams.stream_sessions(spark, sf), duck(sf), ORACLE_SQL["stream_sessions"])
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.shiftright("user_id", sessions.BUCKET_BITS)).distinct().count()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= users
