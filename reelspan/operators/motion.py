"""Poses of episodes: frames with a rotation r (nine numbers by rows) and a translation t (three numbers).

Frames are (episode, frame_idx, kept, r, t). All of it is Column formulas and windows by episode; the
only lists are those of a window of k frames or of a chunk of actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.operators.episodes import by_frame


def camera_metrics(cameras: DataFrame) -> DataFrame:
    """By episode: total rotation in degrees and total distance from frame to frame; 0 for single frames."""
    before = cameras.withColumn("_r", F.lag("r").over(by_frame())).withColumn("_t", F.lag("t").over(by_frame()))
    turned = F.degrees(g.angle(g.product(g.transposed(F.col("_r")), F.col("r"))))
    moved = g.norm(g.minus(F.col("t"), F.col("_t")))
    return before.groupBy("episode").agg(F.coalesce(F.sum(turned), F.lit(0.0)).alias("rotation"), F.coalesce(F.sum(moved), F.lit(0.0)).alias("distance"))


def to_world(poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """Poses in world space by the camera (r, t) of their frame; a frame without one has the identity."""
    held = cameras.select("episode", "frame_idx", F.col("r").alias("_r"), F.col("t").alias("_t"))
    rows = poses.join(held, ["episode", "frame_idx"], "left")
    rows = rows.withColumn("_r", F.coalesce("_r", g.identity())).withColumn("_t", F.coalesce("_t", F.array(*[F.lit(0.0)] * 3)))
    t = g.plus(g.rotate(F.col("_r"), F.col("t")), F.col("_t"))
    return rows.withColumns({"t": t, "r": g.product(F.col("_r"), F.col("r"))}).drop("_r", "_t")


def to_camera(r: Column, t: Column, camera_r: Column, camera_t: Column) -> tuple[Column, Column]:
    """Rotation and translation of a world pose as seen from a camera with a pose in the world."""
    back = g.transposed(camera_r)
    return g.product(back, r), g.rotate(back, g.minus(t, camera_t))


def relative_steps(poses: DataFrame) -> DataFrame:
    """Each frame with the move to its next one: dt and dr = r_next . r transposed; zeros where either isn't kept."""
    nexts = poses.withColumns({"_r": F.lead("r").over(by_frame()), "_t": F.lead("t").over(by_frame())})
    valid = F.col("kept") & F.coalesce(F.lead("kept").over(by_frame()), F.lit(False))
    nexts = nexts.withColumn("valid", valid)
    dt = F.when(F.col("valid"), g.minus(F.col("_t"), F.col("t"))).otherwise(F.array(*[F.lit(0.0)] * 3))
    turn = F.when(F.col("valid"), g.to_euler(g.product(F.col("_r"), g.transposed(F.col("r"))))).otherwise(F.array(*[F.lit(0.0)] * 3))
    return nexts.withColumns({"dt": dt, "turn": turn}).drop("_r", "_t")


def relative_to_anchor(poses: DataFrame, k: int) -> DataFrame:
    """For each frame as anchor and each of its next k frames: the move from the anchor, zeros where either isn't kept."""
    ahead = F.collect_list(F.struct("frame_idx", "kept", "r", "t")).over(by_frame().rowsBetween(1, k))
    held = poses.withColumn("_ahead", ahead)
    rows = held.select("episode", F.col("frame_idx").alias("anchor"), F.col("kept").alias("_k"), F.col("r").alias("_r"), F.col("t").alias("_t"), F.explode("_ahead").alias("n"))
    valid = F.col("_k") & F.col("n.kept")
    zero = F.array(*[F.lit(0.0)] * 3)
    dt = F.when(valid, g.minus(F.col("n.t"), F.col("_t"))).otherwise(zero)
    turn = F.when(valid, g.to_euler(g.product(F.col("n.r"), g.transposed(F.col("_r"))))).otherwise(zero)
    return rows.select("episode", "anchor", F.col("n.frame_idx").alias("frame_idx"), valid.alias("valid"), dt.alias("dt"), turn.alias("turn"))


def action(dt: Column, turn: Column, fingers: Column, width: int = 45) -> Column:
    """One hand's action: relative wrist (six numbers) and the absolute fingers of the next frame, `width` numbers."""
    return F.concat(dt, turn, F.slice(fingers, 1, width))


def action_chunks(steps: DataFrame, k: int) -> DataFrame:
    """chunk: the actions (dt, turn) of a frame and the k - 1 after it, in order, fewer at the episode's end."""
    own = F.collect_list(F.struct("dt", "turn")).over(by_frame().rowsBetween(0, k - 1))
    return steps.withColumn("chunk", own)


def reached(r: Column, t: Column, chunk: Column, mode: str = "step") -> Column:
    """All poses (r, t) along a chunk of relative actions, the start first.

    step: each action moves on from the pose before it; anchor: each from the start.
    """
    start = F.struct(r.alias("r"), t.alias("t"))

    def moved(pose: Column, act: Column) -> Column:
        return F.struct(g.product(g.from_euler(act["turn"]), pose["r"]).alias("r"), g.plus(act["dt"], pose["t"]).alias("t"))

    if mode == "anchor":
        return F.concat(F.array(start), F.transform(chunk, lambda a: moved(start, a)))
    if mode != "step":
        raise ValueError(f"mode is step or anchor, not {mode}")
    return F.aggregate(chunk, F.array(start), lambda path, a: F.concat(path, F.array(moved(F.element_at(path, -1), a))))


def executed(steps: DataFrame, length: int, first: int, blend: float = 0.6) -> DataFrame:
    """The first `first` steps of each chunk of `length` frames; a chunk's first step is blended with the step executed before it."""
    rows = steps.withColumn("chunk", F.floor(F.col("frame_idx") / length)).withColumn("step", F.col("frame_idx") % length)
    done = rows.filter(F.col("step") < first)
    before = F.lag("signal").over(by_frame())
    mixed = (1 - blend) * before + blend * F.col("signal")
    return done.withColumn("executed", F.when((F.col("step") == 0) & before.isNotNull(), mixed).otherwise(F.col("signal")))


def track_sides(detections: DataFrame, track: list[str], right: Column) -> DataFrame:
    """side: the hand of the whole track, left where under half of its detections are right."""
    share = detections.groupBy(*track).agg(F.avg(right.cast("int")).alias("_p"))
    side = F.when(F.col("_p") < 0.5, "left").otherwise("right")
    return detections.join(share, track).withColumn("side", side).drop("_p")


def aligned(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each frame of an episode (episode, n): kept tells whether there is a record; the first shape known holds for all.

    `frames` has episode, frame_idx, signal and shape; of repeated records of a frame the one with the smallest signal counts.
    """
    every = lengths.select("episode", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("frame_idx"))
    own = frames.groupBy("episode", "frame_idx").agg(F.min_by(F.struct("signal", "shape"), F.struct("signal", "shape")).alias("_f"))
    shape = frames.filter("shape IS NOT NULL").groupBy("episode").agg(F.min_by("shape", "frame_idx").alias("first_shape"))
    out = every.join(own, ["episode", "frame_idx"], "left").join(shape, "episode", "left")
    return out.select("episode", "frame_idx", F.col("_f").isNotNull().alias("kept"), F.coalesce("_f.signal", F.lit(0.0)).alias("signal"), "first_shape")


def nearby(frames: DataFrame, mode: str, k: int, seed: Column | None = None) -> DataFrame:
    """k frame numbers of each episode (episode, n): `interior` (even, ends left out), `block` or `distinct` (drawn by `seed`).

    interior: round(i n / (k + 1)) for i from 1, so frames of short episodes repeat; block: k frames in a
    row, all where there are no more; distinct: the k with the smallest draws. `seed` is a whole number
    below 2**32, over episode for a block and over episode and frame_idx for distinct frames.
    """
    if mode == "interior":
        slots = frames.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
        return slots.withColumn("frame_idx", F.bround(F.col("slot") * F.col("n") / (k + 1), 0).cast("long"))
    if mode == "block":
        first = F.when(F.col("n") > k, F.shiftright(seed * (F.col("n") - k), 32)).otherwise(F.lit(0).cast("long"))
        slots = frames.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k), F.col("n")))))
        return slots.withColumn("frame_idx", first + F.col("slot") - 1)
    if mode != "distinct":
        raise ValueError(f"mode is interior, block or distinct, not {mode}")
    every = frames.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("_d", seed)
    w = Window.partitionBy("episode").orderBy("_d", "frame_idx")
    return every.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k).drop("_d")
