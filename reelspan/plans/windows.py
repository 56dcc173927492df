"""Queries over training rows of two hands. The given tables hold no hands, so theirs come from the signal of
`events`: wrists, fifteen fingers and 21 joints in world space under a camera of its own path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.operators import upsampling, windows
from reelspan.operators.episodes import by_frame
from reelspan.plans.motion import flipped, nine, rounded, times, turned
from reelspan.plans.queries import FRAMES, frames, query
from reelspan.sources.tables import table

PAST, FUTURE, CLIP = 2, 3, 12
#: Frames of a task, each some KB with both hands.
EACH = 20_000


HAND = "struct<kept:boolean,r:array<double>,t:array<double>,fingers:array<array<double>>,joints:array<array<double>>,shape:array<double>>"


def rotations(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """`geometry.from_euler` on a last axis of nine."""
    cx, sx, cy, sy, cz, sz = np.cos(x), np.sin(x), np.cos(y), np.sin(y), np.cos(z), np.sin(z)
    return np.stack([cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx], -1)


def _hand(signal: pa.Array, frame: pa.Array, kept: pa.Array) -> pa.Array:
    unknown, late = (c.is_null().to_numpy(zero_copy_only=False) for c in (signal, frame))
    s, f = (c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[:, None] for c in (signal, frame))
    n, j, i, none = len(s), np.arange(15), np.arange(21), unknown[:, None]
    t, no_t = np.concatenate([s / 100, f / 10, np.sin(s)], 1), np.stack([unknown, late, unknown], 1)
    fingers = rotations(0.05 * (j + 1) * np.sin(s), 0.02 * (j + 1) * np.cos(s), np.broadcast_to(0.03 * j, (n, 15)))
    joints = np.stack([t[:, :1] + 0.01 * i, t[:, 1:2] + 0.02 * i * np.cos(s), t[:, 2:] - 0.03 * i], -1)
    no_joints = np.broadcast_to(np.stack([unknown, unknown | late, unknown], -1)[:, None], joints.shape)
    r = rotations(0.3 * np.sin(s), 0.2 * np.cos(s), s / 500)[:, 0]
    parts = [(r, none), (t, no_t), (fingers, none[:, None]), (joints, no_joints), (np.broadcast_to(np.arange(10) / 10, (n, 10)), np.zeros((n, 1), bool))]
    return pa.StructArray.from_arrays([kept, *[upsampling.nested(x, null) for x, null in parts]], ["kept", "r", "t", "fingers", "joints", "shape"])


def hand(s: Column, frame: Column, kept: Column) -> Column:
    """A hand of a signal and a frame's number: 220 numbers, computed for a batch of frames together."""
    return F.arrow_udf(_hand, HAND)(s, frame, kept)


def hand_signals(spark, sf: str) -> DataFrame:
    """Frames with the signals and flags of both hands: the left may use the whole episode, the right its clip of twelve frames."""
    own = frames(spark, sf, EACH).select("episode", "frame_idx", "signal", "event_type")
    own = own.withColumn("last", F.count("*").over(Window.partitionBy("episode")) - 1)
    s, f = F.col("signal"), F.col("frame_idx")
    start = F.floor(f / CLIP) * CLIP
    return own.select(
        "episode", "frame_idx",
        g.from_euler(F.array(f / 40, 0.1 * F.sin(f / 5), F.lit(0.4))).alias("view_r"), F.array(f / 50, F.cos(f / 9), F.lit(1.5)).alias("view_t"),
        s.alias("left_signal"), (F.col("event_type") != "error").alias("left_kept"), (s / 2 + 1).alias("right_signal"), (F.col("event_type") != "signup").alias("right_kept"),
        F.struct(F.lit(0).cast("long").alias("start"), F.col("last").alias("end")).alias("left_range"),
        F.struct(start.alias("start"), F.least(start + CLIP - 1, F.col("last")).alias("end")).alias("right_range"),
    )


def made(rows: pa.RecordBatch, side: str) -> pa.StructArray:
    """A side's hands of frames of `hand_signals`."""
    return _hand(rows.column(f"{side}_signal"), rows.column("frame_idx"), rows.column(f"{side}_kept"))


def two_hands(spark, sf: str) -> DataFrame:
    """Frames with both hands as columns."""
    hands = [hand(F.col(f"{s}_signal"), F.col("frame_idx"), F.col(f"{s}_kept")).alias(s) for s in windows.HANDS]
    return hand_signals(spark, sf).select("episode", "frame_idx", "view_r", "view_t", *hands, "left_range", "right_range")


def weighted(numbers: Column, first: int, count: int) -> Column:
    """Sum of numbers times their place, so that any two exchanged ones show."""
    taken = F.slice(numbers, first + 1, count)
    return F.aggregate(F.transform(taken, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def weighed(numbers: np.ndarray) -> np.ndarray:
    """`weighted` of the last axis, in the same order."""
    total = np.zeros(numbers.shape[:-1])
    for i in range(numbers.shape[-1]):
        total += numbers[..., i] * (i + 1)
    return total


def six_digits(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, and no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def _columns(numbers: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[list[pa.Array], list[str]]:
    """Named arrays and where they are null, rounded, as flat Arrow columns."""
    return [pa.array(six_digits(x).reshape(-1), mask=null.reshape(-1)) for _, x, null in numbers], [name for name, _, _ in numbers]


def _numbers(b: windows.Block) -> pa.RecordBatch:
    """A row a slot and hand of a block: its wrist numbers, and its fingers' as weighted sums."""
    valid, a, r, no_a, no_r = (np.stack([getattr(h, c) for h in b.hands], 2) for c in ("valid", "absolute", "relative", "no_absolute", "no_relative"))
    n, slots = valid.shape[:2]
    # a row of both hands is null as a whole
    no_a, no_r = (np.broadcast_to(x.any(2, keepdims=True), x.shape) for x in (no_a, no_r))
    wrist = [(f"{c}{i}", x[..., i], no) for c, x, no in (("a", a, no_a), ("r", r, no_r)) for i in range(6)]
    columns, names = _columns([*wrist, ("fingers_a", weighed(a[..., 6:]), no_a), ("fingers_r", weighed(r[..., 6:]), no_r)])
    row = pa.array(np.repeat(np.arange(n), 2 * slots))
    slot = pa.array(np.tile(np.repeat(np.arange(slots, dtype=np.int32), 2), n))
    hand = pa.array(windows.HANDS).take(pa.array(np.tile([0, 1], n * slots)))
    return pa.record_batch([b.episode.take(row), b.frame_idx.take(row), slot, hand, windows.flagged(valid), *columns], names=["episode", "frame_idx", "slot", "hand", "valid", *names])


def _moves(spark, sf: str, mode: str) -> DataFrame:
    rows = hand_signals(spark, sf)
    numbers = [f"{c}{i} double" for c in ("a", "r") for i in range(6)] + ["fingers_a double", "fingers_r double"]
    return windows.computed(rows, PAST, FUTURE, mode, "angle", _numbers, f"{windows.keys(rows)}, slot int, hand string, valid boolean, {', '.join(numbers)}", states=False, made=made)


def _matrix(x: str, y: str, z: str) -> list[str]:
    cx, sx, cy, sy, cz, sz = f"cos({x})", f"sin({x})", f"cos({y})", f"sin({y})", f"cos({z})", f"sin({z})"
    return [
        f"{cz} * {cy}", f"{cz} * {sy} * {sx} - {sz} * {cx}", f"{cz} * {sy} * {cx} + {sz} * {sx}",
        f"{sz} * {cy}", f"{sz} * {sy} * {sx} + {cz} * {cx}", f"{sz} * {sy} * {cx} - {cz} * {sx}", f"-{sy}", f"{cy} * {sx}", f"{cy} * {cx}",
    ]


def named(cells: list[str], prefix: str) -> str:
    return ", ".join(f"{c} AS {prefix}{i}" for i, c in enumerate(cells))


IDENTITY = ["1", "0", "0", "0", "1", "0", "0", "0", "1"]
SEEN_T = [f"v{3 * i} * t0 + v{3 * i + 1} * t1 + v{3 * i + 2} * t2 + o{i}" for i in range(3)]
#: Slots of every anchor and hand in the anchor's camera: kept, c0..c8, d0..d2 and the source frame's signal s.
SLOTS = f"""{FRAMES}, n AS (SELECT episode, max(frame_idx) AS last FROM frames GROUP BY episode),
two AS (SELECT episode, frame_idx, 'left' AS hand, signal AS s, event_type <> 'error' AS kept, 0 AS lo, last AS hi FROM frames JOIN n USING (episode)
  UNION ALL SELECT episode, frame_idx, 'right', signal / 2 + 1, event_type <> 'signup', frame_idx // {CLIP} * {CLIP}, least(frame_idx // {CLIP} * {CLIP} + {CLIP - 1}, last) FROM frames JOIN n USING (episode)),
held AS (SELECT *, {named(_matrix("0.3 * sin(s)", "0.2 * cos(s)", "s / 500"), "r")}, s / 100 AS t0, frame_idx / 10 AS t1, sin(s) AS t2 FROM two),
views AS (SELECT episode, frame_idx, {named(_matrix("frame_idx / 40", "0.1 * sin(frame_idx / 5)", "0.4::DOUBLE"), "v")}, frame_idx / 50 AS o0, cos(frame_idx / 9) AS o1, 1.5::DOUBLE AS o2 FROM frames),
asked AS (SELECT episode, frame_idx AS anchor, hand, lo, hi, k, greatest(least(frame_idx + k - {PAST}, hi), lo) AS at,
  CASE WHEN k <= {PAST + FUTURE} THEN frame_idx + k - {PAST} NOT BETWEEN lo AND hi ELSE frame_idx + k - {PAST} > hi AND (frame_idx - {PAST} < lo OR frame_idx + {FUTURE} > hi) END AS outside FROM two, range({PAST + FUTURE + 2}) t(k)),
masked AS (SELECT a.episode, a.anchor, a.hand, a.k, h.kept AND NOT a.outside AS kept, h.s, t0, t1, t2, {named([f"CASE WHEN h.kept AND NOT a.outside THEN r{i} ELSE {x} END" for i, x in enumerate(IDENTITY)], "r")}
  FROM asked a JOIN held h ON h.episode = a.episode AND h.hand = a.hand AND h.frame_idx = a.at),
slots AS MATERIALIZED (SELECT m.episode, anchor, hand, k, kept, s, t0, t1, t2, {named(nine("r"), "w")}, {named(times(nine("v"), nine("r")), "c")}, {named(SEEN_T, "d")}
  FROM masked m JOIN views v ON v.episode = m.episode AND v.frame_idx = m.anchor),
fingers AS (SELECT DISTINCT s, j FROM two, range(15) f(j)),
bones AS MATERIALIZED (SELECT s, j, {named(_matrix("0.05 * (j + 1) * sin(s)", "0.02 * (j + 1) * cos(s)", "0.03 * j"), "m")}, 0.05 * (j + 1) * sin(s) AS e0, 0.02 * (j + 1) * cos(s) AS e1, 0.03 * j AS e2 FROM fingers)"""


def moves_sql(base: str) -> str:
    """SQL of the moves whose base slot fulfils `base`."""
    turn = turned(times(nine("y.m"), flipped(nine("x.m"))))
    fingers = " + ".join(f"(3 * x.j + {i + 1}) * ({x})" for i, x in enumerate(turn))
    plain = " + ".join(f"(3 * x.j + {i + 1}) * y.e{i}" for i in range(3))
    absolute = [f"y.d{i}" for i in range(3)] + turned(nine("y.c"))
    relative = [f"y.d{i} - x.d{i}" for i in range(3)] + turned(times(nine("y.c"), flipped(nine("x.c"))))
    wrist = ", ".join(rounded(f"CASE WHEN x.kept AND y.kept THEN {e} ELSE 0 END") + f" AS {c}{i}" for c, es in (("a", absolute), ("r", relative)) for i, e in enumerate(es))
    return f"""WITH {SLOTS}, p AS (SELECT x.s AS xs, y.s AS ys, x.episode, x.anchor AS frame_idx, y.k - 1 AS slot, x.hand, x.kept AND y.kept AS valid, {wrist}
  FROM slots y JOIN slots x ON x.episode = y.episode AND x.anchor = y.anchor AND x.hand = y.hand AND {base} WHERE y.k > 0),
turns AS (SELECT xs, ys, sum({plain}) AS fa, sum({fingers}) AS fr FROM (SELECT DISTINCT xs, ys FROM p WHERE valid) d JOIN bones x ON x.s = xs JOIN bones y ON y.s = ys AND y.j = x.j GROUP BY xs, ys)
SELECT p.* EXCLUDE (xs, ys), round(CASE WHEN valid THEN fa ELSE 0 END, 6) + 0 AS fingers_a, round(CASE WHEN valid THEN fr ELSE 0 END, 6) + 0 AS fingers_r
FROM p LEFT JOIN turns t ON t.xs = p.xs AND t.ys = p.ys"""


@query(moves_sql("x.k = y.k - 1"))
def training_steps(spark, sf):
    """Windows of two frames back and three ahead, each action against the frame before it."""
    return _moves(spark, sf, "step")


@query(moves_sql(f"x.k = {PAST}"))
def training_anchors(spark, sf):
    """The same windows, each action against the anchor."""
    return _moves(spark, sf, "anchor")


JOINT = ["t0 + 0.01 * j", "t1 + 0.02 * j * cos(s)", "t2 - 0.03 * j"]
IN_HAND = " + ".join(f"(3 * j + {i + 1}) * ({' + '.join(f'w{3 * k + i} * ({JOINT[k]} - t{k})' for k in range(3))})" for i in range(3))


def _states(b: windows.Block) -> pa.RecordBatch:
    kept, state, no = (np.stack([getattr(h, c) for h in b.hands], 1) for c in ("kept", "state", "no_state"))
    no = np.broadcast_to(no.any(1, keepdims=True), no.shape)
    joints, shape = state[..., 6:-10], np.zeros(no.shape)
    for i in range(10):
        shape += state[..., i - 10]
    columns, names = _columns([*[(f"s{i}", state[..., i], no) for i in range(6)], ("joints", weighed(joints), no), ("shape", shape, no)])
    row = pa.array(np.repeat(np.arange(len(no)), 2))
    hand = pa.array(windows.HANDS).take(pa.array(np.tile([0, 1], len(no))))
    return pa.record_batch([b.episode.take(row), b.frame_idx.take(row), hand, windows.flagged(kept), *columns], names=["episode", "frame_idx", "hand", "kept", *names])


@query(f"""WITH {SLOTS}, j AS (SELECT *, (SELECT sum({IN_HAND}) FROM range(21) f(j)) AS joints FROM slots)
SELECT episode, anchor AS frame_idx, hand, kept, {", ".join(rounded(x) + f" AS s{i}" for i, x in enumerate(["d0", "d1", "d2", *turned(nine("c"))]))}, round(joints, 6) + 0 AS joints, 4.5::DOUBLE AS shape
FROM j WHERE k = {PAST}""")
def training_states(spark, sf):
    """States with the joints in hand space."""
    rows = hand_signals(spark, sf)
    numbers = ", ".join(f"{c} double" for c in [*[f"s{i}" for i in range(6)], "joints", "shape"])
    return windows.computed(rows, PAST, FUTURE, "step", "keypoints", _states, f"{windows.keys(rows)}, hand string, kept boolean, {numbers}", actions=False, made=made)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label % 3 <> 0 AS l, label % 2 = 0 AS r FROM embeddings)
SELECT vec_id, round(CASE WHEN l THEN x[1] ELSE 0 END, 6) AS first, round(CASE WHEN r THEN x[33] ELSE 0 END, 6) AS second,
  (CASE WHEN l THEN 27 ELSE 0 END + CASE WHEN r THEN 27 ELSE 0 END)::BIGINT AS state_numbers, (CASE WHEN l THEN 32 ELSE 0 END + CASE WHEN r THEN 32 ELSE 0 END)::BIGINT AS action_numbers,
  round(list_sum([CASE WHEN CASE WHEN i <= 32 THEN l ELSE r END THEN x[i] * i ELSE 0 END for i in range(1, 65)]), 6) + 0 AS total, 192::BIGINT AS actions, 212::BIGINT AS states
FROM v""")
def unified_rows(spark, sf):
    """Actions and states of two hands, padded to the numbers of all features; states lose five numbers of shape a hand."""
    mask = F.array(F.col("label") % 3 != 0, F.col("label") % 2 == 0)
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), mask.alias("mask"))
    actions, flags = windows.unified_actions(F.array("x"), F.array("mask"))
    state, known = windows.unified_state(F.col("x"), F.col("mask"), 54)
    rows = rows.select("vec_id", actions[0].alias("a"), flags[0].alias("f"), state.alias("s"), known.alias("k"))

    def count(c: str) -> Column:
        return F.size(F.filter(c, lambda f: f)).cast("long")

    return rows.select(
        "vec_id", F.round(F.get("s", 0), 6).alias("first"), F.round(F.get("s", 27), 6).alias("second"), count("k").alias("state_numbers"), count("f").alias("action_numbers"),
        F.round(weighted(F.col("a"), 0, 192), 6).alias("total"), F.size("a").cast("long").alias("actions"), F.size("s").cast("long").alias("states"),
    )


@query("""SELECT vec_id, round(list_sum([CASE WHEN (i - 1) % 32 < 6 THEN x[i] ELSE -2 * x[i] END * i for i in range(1, 65)]), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)""")
def mixed_actions(spark, sf):
    """Relative wrists beside absolute fingers."""
    x = F.col("embedding").cast("array<double>")
    mixed = windows.mixed_actions(F.array(F.transform(x, lambda v: -2 * v)), F.array(x))
    return table(spark, sf, "embeddings").select("vec_id", F.round(weighted(mixed[0], 0, 64), 6).alias("total"))


SPAN = 5
SIX = [f"r{i}" for i in range(6)]
MIXED = [*SIX, "t0", "t1", "t2"]


def _upsampled_sql() -> str:
    def cases(c: str) -> str:
        even = f"CASE WHEN kept THEN {c} WHEN b_kept THEN CASE WHEN bb_kept THEN 2 * b_{c} - bb_{c} ELSE b_{c} END ELSE gone_{c} END"
        odd = f"CASE WHEN NOT kept THEN gone_{c} WHEN n_kept THEN ({c} + n_{c}) / 2 WHEN b_kept THEN {c} + 0.5 * ({c} - b_{c}) ELSE {c} END"
        return f"CASE WHEN half = 0 THEN {even} ELSE {odd} END AS {c}"

    around = ", ".join(f"{f} OVER w AS {p}_{c}" for c in [*MIXED, "kept"] for p, f in (("b", f"lag({c})"), ("bb", f"lag({c}, 2)"), ("n", f"lead({c})")))
    gone = ", ".join(f"coalesce(first_value(CASE WHEN NOT kept THEN {c} END IGNORE NULLS) OVER v, first_value({c}) OVER v) AS gone_{c}" for c in MIXED)
    known = [c.replace("b_kept", "coalesce(b_kept, false)").replace("bcoalesce(b_kept, false)", "coalesce(bb_kept, false)") for c in map(cases, MIXED)]
    unit = "sqrt(r0 * r0 + r1 * r1 + r2 * r2)"
    return f"""WITH {SLOTS}, l AS (SELECT a.episode, a.frame_idx AS anchor, i AS slot, least({SPAN - 1}, a.hi - a.frame_idx) AS last, h.kept, {", ".join(f"h.{c}" for c in MIXED)}
  FROM two a JOIN held h ON h.episode = a.episode AND h.hand = 'left', range({SPAN}) r(i) WHERE a.hand = 'left' AND h.frame_idx = a.frame_idx + i),
m AS (SELECT *, {around}, {gone} FROM l WINDOW w AS (PARTITION BY episode, anchor ORDER BY slot), v AS (PARTITION BY episode, anchor ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT episode, anchor, 2 * slot + half AS place, CASE WHEN half = 0 THEN kept OR coalesce(b_kept, false) ELSE kept END AS valid, {", ".join(known)} FROM m, range(2) h(half) WHERE half = 0 OR slot < last),
y AS (SELECT *, r0 / {unit} AS a0, r1 / {unit} AS a1, r2 / {unit} AS a2 FROM x), z AS (SELECT *, a0 * r3 + a1 * r4 + a2 * r5 AS dot FROM y),
u AS (SELECT *, r3 - dot * a0 AS c0, r4 - dot * a1 AS c1, r5 - dot * a2 AS c2 FROM z), done AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS size FROM u)
SELECT episode, anchor AS frame_idx, place::INT AS at, valid, {", ".join(rounded(c) + f" AS {c}" for c in ("t0", "t1", "t2"))}, {rounded("a0")} AS r0, {rounded("c1 / size")} AS r4, {rounded("(a0 * c1 - a1 * c0) / size")} AS r8 FROM done"""


@query(_upsampled_sql())
def upsampled_hands(spark, sf):
    """Left hands of five frames at twice the rate, linear in six numbers of rotation and in place."""
    rows = two_hands(spark, sf).select("episode", "frame_idx", "left.*")
    held = F.collect_list(F.struct("kept", "r", "t", "fingers", F.flatten("joints").alias("joints"))).over(by_frame().rowsBetween(0, SPAN - 1))
    windowed = rows.select("episode", "frame_idx", held.alias("w"))
    done = windowed.select("episode", "frame_idx", upsampling.upsample(*[F.col(f"w.{c}") for c in ("kept", "r", "t", "fingers", "joints")], 2, "linear").alias("u"))
    each = done.select("episode", "frame_idx", F.posexplode(F.arrays_zip("u.kept", "u.r", "u.t")).alias("at", "s"))
    return each.select("episode", "frame_idx", "at", F.col("s.kept").alias("valid"), *[F.round(F.get("s.t", i), 6).alias(f"t{i}") for i in range(3)], *[F.round(F.get("s.r", i), 6).alias(f"r{i}") for i in (0, 4, 8)])
