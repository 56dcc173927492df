"""Cases of the third review: zeros with a sign, sketches, stems of videos, windows computed together, scenes of a small file."""

import contextlib
import io
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.operators import lookup, upsampling, windows
from reelspan.plans import windows as plans
from reelspan.registry import QUERIES
from reelspan.sources.tables import spread


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_angles_keep_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-0.0, -1.0), (0.0, -1.0), (-0.0, 1.0), (-1.0, -1.0), (None, 1.0)], "y double, x double")
    found = [r.a for r in df.select(g.atan2(F.col("y"), F.col("x")).alias("a")).collect()]
    assert found == [-math.pi, math.pi, 0.0, math.atan2(-1, -1), None]


def test_no_sketch_a_user(spark, sf):
    own = plan(QUERIES["approximate_users"](spark, sf))
    keys = re.findall(r"keys=\[([^\]]*)\], functions=\[[^\]]*approx_count_distinct", own)
    assert keys and not any("user_id" in k for k in keys)


def test_names_of_annotations_are_never_broadcast(spark):
    videos = spark.createDataFrame([("v1",), ("s_v1",), ("p_1",), ("absent",), ("v1",)], "stem string")
    names = spark.createDataFrame([("ds_v1_ep_7",), ("ds_v1_ep_10",), ("ds_v12_ep_1",), (None,)], "name string")
    expected = [("absent", None), ("p_1", "ds_v12_ep_1"), ("s_v1", "ds_v12_ep_1" if "ds_v12_ep_1" < "ds_v1_ep_10" else "ds_v1_ep_10"), ("v1", "ds_v1_ep_10"), ("v1", "ds_v1_ep_10")]
    expected[1] = ("p_1", min(n for n in ("ds_v1_ep_7", "ds_v1_ep_10", "ds_v12_ep_1") if "p_1" in n))
    for few in (0, 100):
        out = lookup.annotation_of(videos, names, few)
        assert sorted((r.stem, r.name) for r in out.collect()) == expected
    many = plan(lookup.annotation_of(videos, names, 0))
    assert not re.search(r"BroadcastHashJoin \[stem", many)


def test_windows_computed_together_are_as_each_alone():
    rng = np.random.default_rng(3)
    rows = [(list(map(bool, rng.random(n) < 0.7)), rng.random((n, 9)).tolist(), rng.random((n, 3)).tolist(), rng.random((n, 15, 9)).tolist(), rng.random((n, 63)).tolist()) for n in rng.integers(1, 6, 40)]
    rows[7] = (None, *rows[7][1:])
    parts = [pa.array(list(c)) for c in zip(*rows, strict=True)]
    for method in upsampling.METHODS:
        both = upsampling._finer_rows(parts, 2, method).to_pylist()
        for i, r in enumerate(both):
            assert r == upsampling._finer_rows([p.slice(i, 1) for p in parts], 2, method).to_pylist()[0]
        assert both[7]["kept"] is None and all(len(r["r"]) == 2 * len(w[0]) - 1 for r, w in zip(both, rows, strict=True) if w[0])


def test_scenes_and_frames_are_dealt_out(spark, sf):
    rows = spread(spark.range(1000).coalesce(1), 10, "id")
    assert rows.rdd.getNumPartitions() == 100
    for name in ("training_states", "upsampled_hands", "placed_objects", "answered_instructions", "answers_without_instructions", "single_arm_rows"):
        assert name == "placed_objects" or "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf)), name


def test_training_rows_hold_no_neighbours_as_rows(spark, sf):
    for name in ("training_anchors", "training_steps", "training_states"):
        assert "collect_list" not in plan(QUERIES[name](spark, sf)), name


def test_training_rows_are_the_same_in_batches_of_any_size(spark, sf, monkeypatch):
    frames = plans.two_hands(spark, sf).filter("episode < 3")
    for mode, kind in (("step", "angle"), ("anchor", "keypoints")):
        found = []
        for size in ("10000", "5", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found.append(sorted(map(str, windows.training_rows(frames, 2, 3, mode, kind).collect())))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found[0]) > 10 and found[0] == found[1] == found[2]


def test_hands_without_a_signal_have_null_numbers(spark):
    df = spark.createDataFrame([(0, 0, None, True), (0, 1, 2.0, True), (0, 2, 3.0, None)], "episode long, frame_idx long, s double, kept boolean")
    own, span = plans.hand(F.col("s"), F.col("frame_idx"), F.col("kept")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"))
    view = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    frames = df.select("episode", "frame_idx", view.alias("view_r"), F.array(*[F.lit(0.0)] * 3).alias("view_t"), own.alias("left"), own.alias("right"), span.alias("left_range"), span.alias("right_range"))
    rows = windows.training_rows(frames, 0, 1).orderBy("frame_idx").collect()
    assert rows[0].mask == [[True, True], [None, None]] and rows[0].relative[0] is None and not any(rows[0].absolute[1])
    assert len(rows[0].absolute[0]) == 102 and rows[0].state is None and rows[0].state_mask == [True, True]
    assert rows[2].state_mask == [None, None] and len(rows[2].state) == 122
