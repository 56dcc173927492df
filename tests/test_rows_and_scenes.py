"""Training rows, hands between frames, layouts, placed scenes, assembled and selected instructions, answers: hand-made cases and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.functions import answers, robot
from reelspan.functions import geometry as g
from reelspan.operators import assembly, placement, selection, upsampling, windows
from reelspan.plans import cuts, scenes
from reelspan.plans.windows import hand


def few_frames(spark, n, kept=lambda f: True, ranges=None):
    rows = [(0, f, kept(f), *(ranges or (0, n - 1))) for f in range(n)]
    df = spark.createDataFrame(rows, "episode long, frame_idx long, kept boolean, a long, b long")
    own = hand(F.col("frame_idx") / 7, F.col("frame_idx"), F.col("kept"))
    view = g.from_euler(F.array(F.col("frame_idx") / 9, F.lit(0.2), F.lit(0.1)))
    span = F.struct(F.col("a").alias("start"), F.col("b").alias("end"))
    return df.select("episode", "frame_idx", view.alias("view_r"), F.array(*[F.lit(1.0)] * 3).alias("view_t"), own.alias("left"), own.alias("right"), span.alias("left_range"), span.alias("right_range"))


def masks(df, past=1, future=1, **how):
    return {r.frame_idx: "".join("-+"[m[0]] for m in r.mask) for r in windows.training_rows(df, past, future, **how).collect()}


def test_windows_mask_what_lies_outside(spark):
    # the last frame's own move counts only where the whole window lies inside
    assert masks(few_frames(spark, 4)) == {0: "-++", 1: "+++", 2: "+++", 3: "+--"}
    assert masks(few_frames(spark, 4), mode="anchor") == {0: "+++", 1: "+++", 2: "+++", 3: "+--"}
    assert masks(few_frames(spark, 4, kept=lambda f: f != 1)) == {0: "---", 1: "--+", 2: "-++", 3: "+--"}
    assert masks(few_frames(spark, 1)) == {0: "---"}


def test_rows_are_whole_and_zero_where_masked(spark):
    for kind, width in (("angle", 51), ("keypoints", 69)):
        for r in windows.training_rows(few_frames(spark, 3), 1, 1, kind=kind).collect():
            assert {len(a) for a in r.absolute} == {2 * width} and {len(a) for a in r.relative} == {102} and len(r.state) == 2 * (width + 10)
            for a, b, m in zip(r.absolute, r.relative, r.mask, strict=True):
                assert m[0] or not any(a) and not any(b)
    with pytest.raises(ValueError):
        windows.training_rows(few_frames(spark, 2), 1, 1, mode="other")


def test_splines():
    at = np.arange(2, 9)
    for f in (lambda x: 3 * x * x - x + 1, lambda x: x + 0.5):
        values = np.stack([f(at.astype(float)), -f(at.astype(float))], 1)
        where = np.linspace(1.5, 9, 40)
        assert np.allclose(upsampling.quadratic(at, values, where)[:, 0], f(where))
    rng = np.random.default_rng(0)
    values = rng.normal(size=(7, 3))
    for method in upsampling.METHODS.values():
        assert np.allclose(method(at, values, at.astype(float)), values)
    assert len(upsampling.quadratic(at[:3], values[:3], np.array([2.5]))) == 1


def test_upsampled_runs_and_gaps():
    points = np.array([[0.0], [2.0], [9.0], [9.0], [4.0]])
    out, mask = upsampled = upsampling.upsampled(points, np.array([True, True, False, False, True]), 2, "linear")
    assert out[:, 0].tolist() == [0, 1, 2, 3, 4, 9, 9, 9, 4] and mask.tolist() == [True] * 5 + [False] * 3 + [True], upsampled
    assert upsampling.upsampled(points, np.zeros(5, bool), 2, "pchip")[0][:, 0].tolist() == [0.0] * 9
    assert upsampling.upsampled(points[:1], np.ones(1, bool), 3, "pchip")[0].tolist() == [[0.0]]


@pytest.mark.parametrize("method", ["pchip", "linear", "quadratic"])
def test_hands_between_frames_keep_their_bones(spark, method):
    rows = few_frames(spark, 6).select("left.*", "frame_idx").orderBy("frame_idx")
    window = rows.agg(*[F.sort_array(F.collect_list(F.struct("frame_idx", c)))[c].alias(c) for c in ("kept", "r", "t", "fingers")], F.sort_array(F.collect_list(F.struct("frame_idx", F.flatten("joints").alias("j"))))["j"].alias("joints"))
    u = window.select(upsampling.upsample(*[F.col(c) for c in ("kept", "r", "t", "fingers", "joints")], 2, method).alias("u")).first().u
    old = rows.collect()
    assert len(u.kept) == 11 and all(u.kept)
    for i, r in enumerate(old):
        assert np.allclose(u.r[2 * i], r.left.r if hasattr(r, "left") else r.r) and np.allclose(u.t[2 * i], r.t) and np.allclose(u.fingers[2 * i], r.fingers)
    for m in u.r:
        m = np.array(m).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and math.isclose(np.linalg.det(m), 1)
    bones = [np.array(j).reshape(21, 3) for j in u.joints]
    lengths = [[np.linalg.norm(j[i] - j[p]) for i, p in enumerate(upsampling.PARENTS) if p >= 0] for j in bones]
    own = [np.array(r.joints) for r in old]
    for i, j in enumerate(own):
        assert np.allclose(lengths[2 * i], [np.linalg.norm(j[k] - j[p]) for k, p in enumerate(upsampling.PARENTS) if p >= 0], atol=1e-6)
    assert upsampling.PARENTS == [-1, 0, 1, 2, 3, 0, 5, 6, 7, 0, 9, 10, 11, 0, 13, 14, 15, 0, 17, 18, 19]
    none = window.select(upsampling.upsample(F.lit(None).cast("array<boolean>"), *[F.col(c) for c in ("r", "t", "fingers", "joints")], 2, method).alias("u")).first().u
    assert none is None or none.kept is None


def test_layouts(spark):
    x = list(map(float, range(1, 25)))
    df = spark.createDataFrame([(x, [True] + [False] * 23)], "x array<double>, m array<boolean>")
    human = robot.to_human(F.col("x"))
    r = df.select(human.alias("h"), robot.with_passive_joints(human, 102).alias("p"), robot.to_robot(human).alias("b"), robot.human_mask(F.col("m"), 192).alias("m"), robot.joint_angles(F.slice("x", 1, 6)).alias("j")).first()
    assert r.b == x and [r.h[i] for i in (0, 5, 26, 35, 17, 8, 47, 42, 51, 77)] == [1, 6, 7, 8, 9, 10, 11, 12, 13, 19]
    assert [r.p[i] for i in (29, 38, 20, 11, 50, 45)] == [7, 8, 9, 10, 11, 12] and sum(r.m) == 51
    assert np.allclose(r.j, [1.7 - 1 * 1.7, 1.7 - 2 * 1.7, 1.7 - 3 * 1.7, 1.7 - 4 * 1.7, 0.5 - 5 * 0.5, 1.3 - 6 * 1.4])
    vector, mask = robot.scattered({"HUMAN_LEFT_6D": F.slice("x", 1, 6), "HUMAN_LEFT_ROT": F.slice("x", 20, 3), "HUMAN_RIGHT_HAND": F.lit(None).cast("array<double>")}, robot.ACTION_PARTS, 192)
    r = df.select(vector.alias("v"), mask.alias("m"), robot.gathered(vector, mask, robot.ACTION_PARTS).alias("g")).first()
    assert r.v[:7] == [1, 2, 3, 20, 21, 22, 0] and sum(r.m) == 6 and r.g["HUMAN_LEFT_ROT"] == [20, 21, 22] and "HUMAN_RIGHT_HAND" not in r.g
    fixed = spark.range(1).select(robot.camera_pose().alias("c")).first().c
    assert np.allclose(fixed.r, robot.fixed_camera()[0]) and np.allclose(fixed.t, robot.fixed_camera()[1])


def test_placed_boxes_are_legal(spark, sf):
    desks = scenes.desks(spark, sf)
    found = {r.scene: r for r in placement.placed(desks, scenes.LAYOUT).collect()}
    least, placed = scenes.LAYOUT.apart * 480, 0
    assert len(found) == desks.count()
    for d in desks.collect():
        boxes = [b.box for b in found[d.scene].boxes or []]
        placed += bool(boxes)
        assert len(boxes) in (0, d.objects)
        for b in boxes:
            assert 0 <= b.x0 < b.x1 <= 640 and 0 <= b.y0 < b.y1 <= 480 and (b.x1 - b.x0) % 16 == 0
            assert all(b.x1 <= z.x0 or z.x1 <= b.x0 or b.y1 <= z.y0 or z.y1 <= b.y0 for z in d.zones)
        centres = [((b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2) for b in boxes]
        assert all(math.dist(p, q) >= least for i, p in enumerate(centres) for q in centres[:i])
    assert 0 < placed < len(found)


def test_scene_without_room_is_told(spark):
    row = [(1, 1, [(0, 0, 640, 480)]), (2, 1, []), (3, 0, [])]
    desks = spark.createDataFrame(row, "scene long, objects int, zones array<struct<x0:int,y0:int,x1:int,y1:int>>")
    found = {r.scene: r.attempt for r in placement.placed(desks, placement.Layout()).collect()}
    assert found == {1: None, 2: 0, 3: None}


def test_assembly_keeps_to_its_caps(spark):
    templates = spark.createDataFrame([(0, "t", "put the {d1} {n1} on the {n2}", [("d1", "quality"), ("n1", "object"), ("n2", "object")])], "place long, template_id string, pattern string, slots array<struct<name:string,kind:string>>")
    words = spark.createDataFrame([("d1", w, 0) for w in ("red", "big")] + [(s, w, 0) for s in ("n1", "n2") for w in ("cup", "box", "pan", "jar")], "slot string, word string, used long")
    known = spark.createDataFrame([("Put the  red cup on the box",)], "instruction string")
    out = assembly.assembled(templates, words, known, 20, 6, 5, rounds=4).collect()
    texts = [r.instruction for r in out]
    assert len(set(texts)) == len(texts) and "put the red cup on the box" not in texts and 0 < len(texts) <= 12  # four words, six times each, two a text
    uses = [w for r in out for w in r.objects]
    assert max(map(uses.count, set(uses))) <= 6 and all(len(set(r.objects)) == 2 for r in out)
    assert len(assembly.assembled(templates, words, known, 3, 6, 5).collect()) == 3
    assert assembly.assembled(templates, words.filter("slot <> 'n2'"), known, 3, 6, 5).count() == 0


def brute_selection(rows, k, outside, caps):
    """Takes candidates one by one, as the fold has to."""
    pool = sorted(rows, key=lambda r: (-r.score, r.id, r.key))
    taken, keys, tags = [], set(), []

    def take(items, n, phase):
        got = 0
        for r in items:
            if got >= n:
                break
            if r.key in keys or any(tags.count(t) >= caps.get(t, 1) for t in r.tags):
                continue
            taken.append((r.id, phase))
            keys.add(r.key)
            tags.extend(r.tags)
            got += 1

    first = [r for r in pool if r.reserved][:1]
    for r in first:
        taken.append((r.id, -1))
        keys.add(r.key)
        tags.extend(r.tags)
    rest = k - len(first)
    edits = [r for r in pool if r.needs_edit]
    share = min(max(1, math.ceil(rest * outside)) if outside > 0 else 0, rest, len(edits))
    take(edits, share, 0)
    take([r for r in pool if not r.needs_edit], rest - share, 1)
    take(pool, k - len(taken), 2)
    return taken[:k]


def test_selection_equals_taking_one_by_one(spark, sf):
    pool = cuts.candidate_pool(spark, sf)
    by_scene = {}
    for r in pool.collect():
        by_scene.setdefault(r.scene, []).append(r)
    for k, outside in ((4, 0.3), (3, 0.0), (7, 0.5), (1, 0.3)):
        found = {}
        for r in selection.select_instructions(pool, k, outside, cuts.CAPS).orderBy("scene", "place").collect():
            found.setdefault(r.scene, []).append((r.id, r.phase))
        assert found == {s: t for s, rows in by_scene.items() if (t := brute_selection(rows, k, outside, cuts.CAPS))}
    assert selection.bounded_pools(pool, 6).count() == sum(len(v) > 6 for v in by_scene.values())


def test_recut_conserves_frames(spark, sf):
    segments, moved, _ = cuts.recut(spark, sf)
    own = segments.collect()
    assert sorted(s.new_episode for s in own) == list(range(len(own)))
    assert moved.count() == sum(s.frames for s in own)
    per = {}
    for s in own:
        per.setdefault(s.episode, []).append(s)
    for pieces in per.values():
        pieces.sort(key=lambda s: s.segment)
        assert pieces[0].start == 0 and all(a.end == b.start for a, b in zip(pieces, pieces[1:], strict=False))


CASES = {
    '[{"instruction": "Pick a cup", "noun": "cup", "verbs": "Pick"}]': [("Pick a cup", ["cup"], ["pick"])],
    '```json\n{"instr": "Lift it", "nouns": [" a ", ""]}\n```': [("Lift it", ["a"], [])],
    'Sure [{"instr": "x"}, 3, {"instruction": ""}] ok': [("x", [], [])],
    "1. Pick the red cup up\n2) Sing to the cup\n3. Lift": [("Pick the red cup up", [], [])],
    '{"instr": "Push the box forward",\n': [("Push the box forward", [], [])],
    "7": [],
    "": [],
    None: [],
    "[1, 2": [],
    "```": [],
    '{"instr": null, "instruction": null}': [],
}


def test_answers_of_every_form(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i long, answer string")
    found, failed = answers.parsed(df, "answer", 5)
    held = {}
    for r in found.orderBy("i", "place").collect():
        held.setdefault(r.i, []).append((r.instruction, r.nouns, r.verbs))
    for i, (text, expected) in enumerate(CASES.items()):
        assert held.get(i, []) == expected, text
    assert {r.i for r in failed.collect()} == {i for i, e in enumerate(CASES.values()) if not e}
    words = df.limit(1).select(answers.proposed_words(F.lit('<think>{"words": ["a"]}</think> {"words": ["B ", ""]}')).alias("w"), answers.proposed_words(F.lit(None).cast("string")).alias("n")).first()
    assert words.w == ["b"] and words.n == []
