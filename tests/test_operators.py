"""Small hand-made cases and properties of the operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.functions import text
from reelspan.operators import corpus, draws, episodes, lookup, motion, sampling, scenes, snapshots, vectors, vocabulary
from reelspan.registry import QUERIES
from reelspan.sources import tables
from reelspan.streaming import jobs


def one(spark, **columns):
    return [v for v in spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()]


def test_hands_round_trip(spark):
    rows = spark.createDataFrame([("Pick it up.", None), (" ", "Push left"), (None, None)], "l string, r string")
    made = rows.withColumn("t", text.format_hands(F.col("l"), F.col("r")))
    got = [tuple(r) for r in made.select("t", text.parse_hand(F.col("t"), "left"), text.parse_hand(F.col("t"), "right")).collect()]
    assert got == [("Left hand: Pick it up. Right hand: None.", "Pick it up", None), ("Left hand: None. Right hand: Push left.", None, "Push left"), ("Left hand: None. Right hand: None.", None, None)]


def test_text_columns(spark):
    swapped, labels, safe, found = one(spark, a=text.swap_sides(F.lit("Left of the upright right leftover")), b=text.merge_lists(F.lit("a, b，c"), F.lit("b,,d")), c=text.safe_label(F.lit("a b/c-d_e")), d=text.json_in(F.lit('Sure:\n```json\n{"a": 1}\n```')))
    assert swapped == "Right of the upright left leftover" and labels == "a, b, c, d" and safe == "a_b_c-d_e" and json.loads(found) == {"a": 1}


@pytest.mark.parametrize(
    ("instruction", "valid"),
    [
        ("pick up the cup", True), ("Grasp the cup", True), ("grab the cup", False), ("put the cup on it", False), ("the cup, pick it", False),
        ("fold it", False), ("  fold it ", False), ("fold it up", True), ("pickup the cup", False), (None, False), ("", False),
        ("pick-then-place the cup on the tray", False), ("pick up the cup, grasp-then-place on it", False), ("lift-up the cup", True),
        ("place the cup", False), ("place on the tray", True), ("place it on the tray", True), ("PLACE it NEXT TO the tray", True), ("pick it and place it", False), ("pick it and place it inside", True),
        ("move the cup", False), ("move the cup aside", True), ("push the cup", False), ("push the cup to the left", True), ("slide the cup near it", True), ("pull the cup forward", True), ("pull the cup forwards", False),
        ("open the move box", False), ("align the cups", True), ("unscrew the lid", True), ("twist the lid", True), ("insert the key", True), ("remove the lid", True),
    ],
)
def test_instruction_rules(spark, instruction, valid):
    assert one(spark, a=text.is_valid_instruction(F.lit(instruction).cast("string"))) == [valid]


def test_colour_words(spark):
    found = one(spark, a=text.has_colour(F.lit("a Lime cup")), b=text.has_colour(F.lit("ivory, reddish")), c=text.has_colour(F.lit("a tan, cream, golden or crimson cup")), d=text.has_colour(F.lit("bored")))
    assert found == [True, True, False, False]


def test_mirrored_texts(spark):
    both = "Left hand: Hold the leftmost upright cup. Right hand: Turn Right to the bright leftovers."
    turned = "Left hand: Turn Left to the bleft leftovers. Right hand: Hold the rightmost upright cup."
    found = one(spark, a=text.swap_sides(F.lit(both)), b=text.swap_sides(F.lit("Note. Right hand: a left one. Left hand: None.")), c=text.swap_sides(F.lit("none")), d=text.swap_sides(F.lit(None).cast("string")))
    assert found == [turned, "Left hand: a right one. Right hand: None.", "none", None]


@pytest.mark.parametrize(
    ("a", "b", "near"),
    [
        ((0, 0, 10, 10), (99, 0, 10, 10), True),  # 0 apart along y
        ((0, 0, 10, 10), (99, 99, 10, 10), True),  # 89 apart along both
        ((0, 0, 10, 10), (100, 100, 10, 10), False),  # 90 apart along both
        ((0, 0, 10, 10), (500, 50, 10, 10), True),  # the smaller gap counts
        ((0, 0, 10, 10), (8, 2, 10, 10), False),  # 16 % of the smaller box overlapped
        ((0, 0, 10, 10), (8.5, 0, 10, 10), True),  # 15 % are still next to each other
        ((0, 0, 100, 100), (10, 10, 5, 5), False),
    ],
)
def test_adjacent_boxes(spark, a, b, near):
    boxes = [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", x, strict=True)]) for x in (a, b)]
    assert spark.range(1).select(boxes[0].alias("a"), boxes[1].alias("b")).select(scenes.adjacent("a", "b")).first()[0] is near


@pytest.mark.parametrize(
    ("true", "score"),
    [
        ("", 0), ("both_hands", 50), ("two_objects", 3), ("lays", 4), ("holding", -100), ("holding lays", -100), ("holding grasps_held operates_held", -100),
        ("holding operates_held puts_down primary_held", 40), ("holding operates_held uses both_hands two_objects", 113), ("holding puts_down primary_held", 18),
        ("holding puts_down", -100), ("holding primary_held involves_held", 8), ("holding involves_held", 4), ("uses primary_held", 0),
    ],
)
def test_feasibility(spark, true, score):
    names = "both_hands holding grasps_held operates_held uses puts_down primary_held involves_held lays two_objects".split()
    assert one(spark, a=scenes.feasibility({n: F.lit(n in true.split()) for n in names})) == [score]


def test_hand_summary(spark):
    # episode 1: left valid at 0, 3 and 4, right at 2; 2: as many each; 3: none valid; 4: one frame
    rows = [(1, 0, 1.0, "l"), (1, 1, 50.0, "-"), (1, 2, 9.0, "r"), (1, 3, 4.0, "l"), (1, 4, 2.0, "l"), (2, 0, 0.0, "l"), (2, 1, 7.0, "r"), (3, 0, 1.0, "-"), (3, 1, 2.0, "-"), (4, 0, 5.0, "r")]
    frames = spark.createDataFrame(rows, "episode long, frame_idx long, signal double, hand string")
    got = episodes.hand_summary(frames, {"left": F.col("hand") == "l", "right": F.col("hand") == "r"}).orderBy("episode").collect()
    assert [tuple(r) for r in got] == [(1, 5, 3, 1, 5 / 4, "left"), (2, 2, 1, 1, 0.0, "both"), (3, 2, 0, 0, 0.0, "none"), (4, 1, 0, 1, 0.0, "right")]


def test_rotations(spark):
    e = F.array(F.lit(0.3), F.lit(-0.7), F.lit(1.1))
    m = g.from_euler(e)
    euler, six, straight, whole, angle = one(spark, a=g.to_euler(m), b=g.from_six(g.to_six(m)), c=m, d=g.product(m, g.transposed(m)), e=g.angle(g.product(m, g.transposed(m))))
    assert np.allclose(euler, [0.3, -0.7, 1.1]) and np.allclose(six, straight) and np.allclose(np.reshape(whole, (3, 3)), np.eye(3)) and angle < 1e-6
    fov, turned = one(spark, a=g.field_of_view(F.lit(2.0), F.lit(1.0)), b=g.rotate(g.from_euler(F.array(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    assert math.isclose(fov, math.pi / 2) and np.allclose(turned, [0, 1, 0], atol=1e-12)


def test_boxes(spark):
    box, flat = one(spark, a=g.ordered_box(F.lit(900.4), F.lit(-5.0), F.lit(100.0), F.lit(2000.0)), b=g.ordered_box(F.lit(5.0), F.lit(5.0), F.lit(5.2), F.lit(9.0)))
    assert tuple(box) == (100, 0, 900, 1000) and flat is None


def test_normalising_is_undone(spark):
    x, m, s = (F.array(*map(F.lit, v)) for v in ((1.0, -2.0), (0.5, 3.0), (2.0, 0.0)))
    (back,) = one(spark, a=g.denormalised(g.normalised(x, m, s), m, s))
    assert np.allclose(back, [1, -2])


def test_minima_against_definition():
    rng = random.Random(2)
    for _ in range(50):
        y = np.array([rng.randrange(6) for _ in range(60)], float)
        found = episodes.minima(y, 5, 1.0)
        assert all(b - a >= 5 for a, b in zip(found, found[1:], strict=False))
        for p in found:
            left, right = p, p
            while left > 0 and y[left - 1] == y[p]:
                left -= 1
            while right < len(y) - 1 and y[right + 1] == y[p]:
                right += 1
            assert 0 < left and right < len(y) - 1 and y[left - 1] > y[p] and y[right + 1] > y[p]


def test_split_points_of_one_dip(spark):
    smooth = [0.02] * 25 + [0.001] + [0.02] * 34
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(smooth)] + [(2, i, 0.0) for i in range(29)], "episode long, frame_idx int, smooth double")
    assert {r.episode: r.points for r in episodes.split_points(df).collect()} == {1: [30], 2: []}


def test_steps_rebuild_the_trajectory(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(10)], "episode long, frame_idx long, signal double")
    out = episodes.rebuilt(episodes.step_actions(df, F.lit(True)), F.lit(0.0)).orderBy("frame_idx").collect()
    assert [r.position for r in out] == [float(i * i) for i in range(10)]


def test_chunks_differ_by_one_at_most(spark):
    rows = spark.range(100)
    numbered = sampling.ordinal(rows, F.floor(F.col("id") / 9), [F.col("id")], "i")
    assert all(r.i == r.id for r in numbered.collect())
    sizes = [r["count"] for r in sampling.even_chunks(numbered, "i", 100, 7).groupBy("chunk").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_sample_is_without_replacement(spark):
    words = spark.createDataFrame([("verb", f"w{i}", i) for i in range(50)], "g string, word string, usage long")
    got = corpus.weighted_sample(words, "g", "word", "usage", 10, 2.0, 5).collect()
    assert len({r.word for r in got}) == 10 and np.mean([r.usage for r in got]) < 20


def test_slices_of_errors(spark):
    pairs = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 0.0])], "x array<double>, y array<double>")
    slices = spark.createDataFrame([("a", 0, 1), ("b", 1, 3)], "name string, start int, stop int")
    assert {r.name: r.mse for r in vectors.slice_errors(pairs, "x", "y", slices).collect()} == {"a": 0.0, "b": 6.5}


def test_manifest_quarantine_and_listing(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"task_id": "a", "verbs": ["pick"]}\n{broken\n\n{"task_id": "b"}\n')
    rows = tables.read_manifest(spark, str(tmp_path / "m.jsonl")).cache()
    good, bad = tables.split_quarantine(rows)
    assert sorted(r.task_id for r in good.collect()) == ["a", "b"] and bad.count() == 1
    for n in ("v_ep_000003.npy", "w_ep_000011.npy", "other.npy"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((r.prefix, r.episode_number) for r in tables.episode_files(spark, str(tmp_path)).collect()) == [("v", 3), ("w", 11)]
    (tmp_path / "s.json").write_text('{"e1": {"points": [180, 574], "type": [0, 1, 2], "instructions": ["x", "y", "z"]}}')
    points = tables.read_split_points(spark, str(tmp_path / "s.json")).select(F.col("episode_key").alias("episode"), "points")
    frames = spark.createDataFrame([("e1", i) for i in (0, 180, 181, 574, 575)], "episode string, frame_idx int")
    assert [r.segment for r in episodes.segment_of(frames, points).orderBy("frame_idx").collect()] == [0, 0, 1, 1, 2]


def test_failure_budget(spark):
    run = jobs.with_failure_budget(3, "status = 'failed'")
    batch = spark.createDataFrame([("failed",)] * 2, "status string")
    run(batch, 0)
    try:
        run(batch, 1)
    except RuntimeError:
        return
    raise AssertionError("the budget was passed over")


def near(a, b):
    return (len(a) > 4 and len(b) > 4 and a[:4] == b[:4]) or (abs(len(a) - len(b)) <= 2 and sum(x != y for x, y in zip(a, b, strict=False)) <= 2)


def test_near_words_and_ordered_acceptance(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(70)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {tuple(r) for r in vocabulary.near_pairs(df, "word").collect()} == {(a, b) for a in words for b in words if a < b and near(a, b)}
    taken = []
    for w in words:
        if not any(near(t, w) for t in taken):
            taken.append(w)
    assert sorted(r.word for r in vocabulary.accepted(df, "word").collect()) == taken


def test_monotone_interpolation(spark):
    at, values = np.array([0.0, 2.0, 5.0, 6.0]), np.array([0.0, 1.0, 1.0, 4.0])
    where = np.linspace(0, 6, 61)
    y = episodes.pchip(at, values, where)
    assert np.all(np.diff(y) >= -1e-12) and np.allclose(episodes.pchip(at, values, at), values)
    df = spark.createDataFrame([(1, i, float(i), i in (1, 3, 6)) for i in range(8)], "episode long, frame_idx long, signal double, k boolean")
    got = [r.filled for r in episodes.interpolated_monotone(df, F.col("k")).orderBy("frame_idx").collect()]
    assert got[0] is None and got[7] is None and np.allclose(got[1:7], [1, 2, 3, 4, 5, 6])


def close_to(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def rz(a):
    return [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]


POSE = "episode long, frame_idx long, kept boolean, r array<double>, t array<double>"


def test_camera_metrics_and_relative_moves(spark):
    rows = [(1, i, i != 2, rz(0.1 * i * i), [float(i), 0.0, 0.0]) for i in range(4)] + [(2, 0, True, rz(1.0), [0.0] * 3)]
    poses = spark.createDataFrame(rows, POSE)
    found = {r.episode: r for r in motion.camera_metrics(poses).collect()}
    assert abs(found[1].rotation - 0.9 * 180 / 3.141592653589793) < 1e-9 and found[1].distance == 3.0
    assert found[2].rotation == 0.0 and found[2].distance == 0.0
    steps = {r.frame_idx: r for r in motion.relative_steps(poses).filter("episode = 1").collect()}
    assert [steps[i].valid for i in range(4)] == [True, False, False, False]  # 2 isn't kept, 3 is the last
    assert close_to(steps[0].turn[2], 0.1) and steps[0].dt == [1.0, 0.0, 0.0] and steps[1].turn == [0.0] * 3
    far = {(r.anchor, r.frame_idx): r for r in motion.relative_to_anchor(poses, 3).filter("episode = 1").collect()}
    assert close_to(far[0, 3].turn[2], 0.9) and far[0, 3].valid and not far[0, 2].valid and (3, 4) not in far


def test_chunks_rebuild_poses(spark):
    rows = [(1, i, True, rz(0.2 * i), [float(i * i), 1.0, 0.0]) for i in range(5)]
    chunks = motion.action_chunks(motion.relative_steps(spark.createDataFrame(rows, POSE)), 3)
    step = chunks.filter("frame_idx = 1").select(motion.reached(F.col("r"), F.col("t"), F.col("chunk")).alias("p")).first().p
    assert [round(x.t[0], 9) for x in step] == [1, 4, 9, 16] and close_to(step[-1].r[0], rz(0.8)[0])
    anchor = chunks.filter("frame_idx = 1").select(motion.reached(F.col("r"), F.col("t"), F.col("chunk"), "anchor").alias("p")).first().p
    assert [round(x.t[0], 9) for x in anchor] == [1, 4, 6, 8]  # each action from the start


def test_world_pose_without_camera_stays(spark):
    poses = spark.createDataFrame([(1, 0, True, rz(0.0), [1.0, 0.0, 0.0]), (1, 1, True, rz(0.0), [1.0, 0.0, 0.0])], POSE)
    cameras = spark.createDataFrame([(1, 0, True, rz(3.141592653589793 / 2), [0.0, 0.0, 5.0])], POSE)
    found = {r.frame_idx: r.t for r in motion.to_world(poses, cameras).collect()}
    assert [round(x, 9) for x in found[0]] == [0, 1, 5] and found[1] == [1.0, 0.0, 0.0]


def test_text_rules_by_case(spark):
    lit = F.lit

    def value(column):
        return one(spark, x=column)[0]

    assert value(text.leading_verbs(lit(" Pick the cup then  unscrew it then sing "))) == ["pick", "unscrew"]
    assert value(text.leading_verbs(lit("picking cups"))) == [] and value(text.leading_verbs(lit(None).cast("string"))) == []
    assert value(text.without_openings(lit("Only the LEFT hand is used: both hands enter from the bottom of the frame. 右手从画面右下角伸入画面。lifts it"))) == "lifts it"
    assert value(text.combined_hand(lit("Left hand: pick it.\nRight hand: None."), "left")) == "pick it"
    assert value(text.combined_hand(lit("Left hand: pick it.\nRight hand: None."), "right")) == "None"
    assert [value(text.hand_mode(lit(a), lit(b))) for a, b in (("lift", "hold"), ("lift", "None."), ("none", "hold"), (None, ""))] == ["bimanual", "left", "right", "right"]
    assert value(text.segment_texts(lit("open it and lift the lid"), lit(2))) == ["open it", "lift it", "return home"]
    assert value(text.segment_texts(lit("open it"), lit(1))) == ["open it", "return home"]
    assert [value(text.is_slot_word(lit(w), lit(p))) for w, p in (("next to", True), ("next to", False), ("then", False), ("Cup", False), ("ab", False), (None, False))] == [True, False, False, True, False, False]
    assert [value(text.is_likely_noun(lit(w))) for w in ("station", "nation", "ration", "container", "her")] == [True, False, False, True, False]
    assert value(text.noun_key(lit(" Cutting_ Board "))) == "cutting board" and value(text.object_key(lit("Cup"), lit(None).cast("string"))) == "cup|"
    assert value(text.is_food(lit("Onion"), lit(""))) and value(text.is_food(lit("bit"), lit("sliceable"))) and not value(text.is_food(lit("cup"), lit("red")))
    fields = value(text.single_arm_fields(lit("lift it. "), lit("RIGHT hand lifts"), lit("left")))
    assert (fields.instruction, fields.task, fields.augmented) == ("Left hand: lift it. Right hand: None.", "lift it", "LEFT hand lifts")
    words = value(text.words_of(lit(None).cast("array<string>"), lit(" Cup "), lower=True))
    assert words == ["cup"] and value(text.primary_object(lit(" "), F.array(lit(" Box ")), F.array(lit("cup")))) == "box"


def test_geometry_by_case(spark):
    lit = F.lit

    def value(column):
        return one(spark, x=column)[0]

    assert [value(g.coordinate(lit(v), lit(640), lit(o))) for v, o in ((0.5, 0.5), (0.5, 500.0), (500.0, 1.0), (2000.0, 5.0), (-0.2, 0.1))] == [320, 0, 320, 639, 0]
    assert tuple(value(g.fitted_box(lit(630), lit(-5), lit(3), lit(50), lit(640), lit(480), 20))) == (620, 0, 640, 50)
    assert value(g.fitted_box(lit(0), lit(0), lit(700), lit(50), lit(640), lit(480), 20)) is None
    assert tuple(value(g.share_box_pixels(F.array(*map(lit, (0.5, 0.75, 0.25, 0.25))), lit(100), lit(200)))) == (25, 50, 50, 150)
    assert value(g.share_box_pixels(F.array(*map(lit, (0.5, 0.5, 0.5, 0.6))), lit(100), lit(200))) is None
    assert value(g.swapped_halves(F.array(*map(lit, (1, 2, 3, 4))), lit(True))) == [3, 4, 1, 2]
    h = value(g.homogeneous(g.identity(), F.array(*map(lit, (1.0, 2.0, 3.0)))))
    assert h == [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]


def test_snapshots(spark):
    def frame(rows, count="n"):
        return spark.createDataFrame(rows, f"kind string, word string, {count} long")

    old, batch = frame([("a", "x", 2), ("a", "y", 1)]), frame([("a", "x", 1), ("b", "z", 4), ("a", "x", 1)])
    new = snapshots.merged(old, batch, ["kind", "word"], "n")
    assert {tuple(r) for r in new.collect()} == {("a", "x", 4), ("a", "y", 1), ("b", "z", 4)}
    use = snapshots.usage(new, "kind", "n")
    caps = spark.createDataFrame([("a", 4), ("b", 4)], "kind string, cap long")
    assert [r.kind for r in snapshots.at_cap(use, caps, "kind", ["b"]).collect()] == ["a"]
    slots = spark.createDataFrame([("a",), ("b",), ("c",)], "kind string")
    assert {r.kind for r in snapshots.short_of(slots, use, "kind", 3, 1).collect()} == {"b", "c"}

    def expand(slots, caps, least):
        return snapshots.should_expand(slots, use, caps, "kind", least, ["b"]).first().expand

    high = spark.createDataFrame([("a", 9), ("b", 1)], "kind string, cap long")
    assert expand(slots, high, 9) and not expand(slots.filter("kind <> 'c'"), high, 9)  # an empty slot; b's cap doesn't count
    assert expand(slots.filter("kind <> 'c'"), caps, 9) and expand(slots.filter("kind <> 'c'"), high, 1)
    seeds = spark.createDataFrame([("b", "z", 0), ("b", "u", 1), ("b", "v", 2), ("c", "w", 0)], "kind string, word string, place long")
    grown = snapshots.seeded(new, seeds, "kind", "word", "n", 2)
    assert {tuple(r) for r in grown.filter("n = 0").collect()} == {("b", "u", 0), ("c", "w", 0)}


def test_counters_over_batches_and_replay(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    expected = {tuple(r) for r in events.groupBy("event_type").count().collect()}
    assert {tuple(r) for r in QUERIES["stream_counters"](spark, str(tmp_path)).collect()} == expected
    versions = snapshots.Versions(spark, f"{tmp_path}/versions")
    add = snapshots.counting(versions, ["event_type"], "event_type string, frequency long")
    for number in (0, 1, 1):  # batch 1 comes again
        add(events, number)
    assert {tuple(r) for r in versions.read(1, "event_type string, frequency long").collect()} == {(k, 2 * n) for k, n in expected}


def test_failure_budget_outlives_the_query(spark, tmp_path):
    batch = spark.createDataFrame([("failed",)] * 2, "status string")
    folder = str(tmp_path / "failures")
    for number in (0, 0):  # a replay counts once
        jobs.with_failure_budget(3, "status = 'failed'", folder)(batch, number)
    with pytest.raises(RuntimeError):
        jobs.with_failure_budget(3, "status = 'failed'", folder)(batch, 1)


def test_annotation_of_by_case(spark):
    names = ["d_a_b_ep_2", "d_a_b_ep_1", "xab_ep_0", "_c_ep_0", "q_ep_ep_3", "noend"]
    stems = ["a_b", "b", "ab", "c", "ep", "zz", ""]
    found = lookup.annotation_of(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.stem: r.name for r in found.collect()} == {"a_b": "d_a_b_ep_1", "b": "d_a_b_ep_1", "ab": "xab_ep_0", "c": "_c_ep_0", "ep": "q_ep_ep_3", "zz": None, "": None}


def test_interleaving_keeps_each_order(spark):
    items = spark.createDataFrame([(d, i) for d in "abc" for i in range(50)], "source string, place long")
    out = lookup.interleaved(items, "source", "place", draws.draw(3, F.col("source"), F.col("place"))).orderBy("at", "source", "place").collect()
    for d in "abc":
        assert [r.place for r in out if r.source == d] == list(range(50))
    assert len({r.source for r in out[:20]}) > 1


def test_captions_across_blocks(spark):
    frames = spark.createDataFrame([(1, i) for i in range(600)], "episode long, frame_idx long")
    captions = spark.createDataFrame([(1, 0, 250, 520), (1, 1, 5, 5), (1, 2, 9, 3)], "episode long, clip_idx long, start_frame long, end_frame long")
    assert episodes.captions_at(frames, captions).count() == 270 and episodes.captions_at(frames, captions, closed=True).count() == 272


def test_percentile_is_exact(spark):
    rows = spark.createDataFrame([(k, float((i * 7919) % 1009) / 3) for k in (1, 2) for i in range(1500 * k)] + [(3, 5.0)], "k long, v double")
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        found = {r.k: r.percentile_value for r in corpus.percentile(rows, "k", "v", p, 16).collect()}
        for k in (1, 2):
            values = sorted(float((i * 7919) % 1009) / 3 for i in range(1500 * k))
            assert found[k] == values[min(int(len(values) * p), len(values) - 1)]
        assert found[3] == 5.0


@pytest.mark.parametrize("total, size", [(10, 4), (8, 4), (3, 8), (1, 4)])
def test_full_batches(spark, total, size):
    rows = spark.range(total).withColumnRenamed("id", "place").withColumn("item", F.col("place"))
    padded = sorted((r.place, r.item) for r in sampling.full_batches(rows, "place", total, size, True).collect())
    width = -(-total // size) * size
    assert padded == [(i, i % total) for i in range(width)]
    assert sampling.full_batches(rows, "place", total, size, False).count() == total // size * size


def test_outcomes_count_unknown_and_null(spark):
    rows = spark.createDataFrame([("a", "pass"), ("a", None), ("a", "odd"), ("b", "fail")], "root string, status string")
    found = {r.root: (r["pass"], r.fail, r.other) for r in sampling.outcomes(rows, "root", "status", ["pass", "fail"]).collect()}
    assert found == {"a": (1, 0, 2), "b": (0, 1, 0)}
