"""Cases of the fourth review: hands of training rows are made in the tasks that use them, so that only narrow frames are shuffled."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_findings_r03 import plan

from reelspan.operators import windows
from reelspan.plans import windows as plans
from reelspan.registry import QUERIES


@pytest.mark.parametrize("name", ["training_anchors", "training_steps", "training_states"])
def test_hands_of_training_rows_are_not_shuffled(spark, sf, name):
    own = plan(QUERIES[name](spark, sf))
    moved = re.findall(r"\bExchange (?:hash|range|single|round)\S*", own, re.I)
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in own and "EvalPython" not in own


@pytest.mark.parametrize("mode,kind", [("step", "angle"), ("anchor", "keypoints")])
def test_made_hands_give_the_rows_of_stored_ones(spark, sf, mode, kind):
    stored = sorted(map(str, windows.training_rows(plans.two_hands(spark, sf).filter("episode < 3"), 2, 3, mode, kind).collect()))
    for size in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        made = windows.training_rows(plans.hand_signals(spark, sf).filter("episode < 3"), 2, 3, mode, kind, made=plans.made).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(stored) > 10 and sorted(map(str, made)) == stored


def test_made_hands_are_cut_into_parts_of_frames(monkeypatch):
    monkeypatch.setattr(windows, "MADE_AT_ONCE", 3)
    hands = pa.array([None if i == 1 else {"kept": i != 2, "r": [1.0] * 9, "fingers": None if i == 3 else [[float(i), None], [2.0, 3.0]]} for i in range(8)])
    seen = []

    def made(rows, side):
        seen.append((side, rows.num_rows))
        return hands.take(rows.column("frame_idx"))

    numbers = {c: pa.array(range(8)) for c in ("episode", "frame_idx", "next", "view_r", "view_t", "left_start", "left_end", "right_start", "right_end")}
    rows = pa.Table.from_batches(windows.with_hands([pa.RecordBatch.from_pydict(numbers)], ["kept", "fingers"], made)).to_pydict()
    assert seen == [("left", 3), ("right", 3)] * 2 + [("left", 2), ("right", 2)] and rows["frame_idx"] == list(range(8))
    assert rows["left_kept"] == rows["right_kept"] == [True, None, False, *[True] * 5] and "left_r" not in rows
    assert rows["left_fingers"] == [None if i in (1, 3) else [float(i), None, 2.0, 3.0] for i in range(8)]


def test_flattened_lists_are_as_sparks(spark):
    rows = [[[1.0, 2.0], [3.0]], None, [[4.0], None], [], [[None, 5.0], []], [[6.0]]]
    expected = [r.f for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<array<double>>").orderBy("i").select(F.flatten("x").alias("f")).collect()]
    column = pa.array(rows, pa.list_(pa.list_(pa.float64())))
    assert windows.flattened(column).to_pylist() == expected
    for i in range(len(rows)):
        assert windows.flattened(column.slice(i)).to_pylist() == expected[i:]
