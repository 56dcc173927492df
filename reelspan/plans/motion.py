"""Queries over poses: a frame's rotation and translation are made from its signal, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.operators import draws, episodes, motion
from reelspan.plans.more import SEED, sql_draw
from reelspan.plans.queries import FRAMES, frames, query
from reelspan.sources.tables import table


def poses(spark, sf) -> DataFrame:
    s = F.col("signal")
    turn = F.array(0.3 * F.sin(s), 0.2 * F.cos(s), s / 500)
    t = F.array(s / 100, F.col("frame_idx") / 10, F.sin(s))
    return frames(spark, sf).select("episode", "frame_idx", (F.col("event_type") != "error").alias("kept"), g.from_euler(turn).alias("r"), t.alias("t"))


POSES = f"""{FRAMES}, e AS (SELECT episode, frame_idx, event_type <> 'error' AS kept, 0.3 * sin(signal) AS x, 0.2 * cos(signal) AS y, signal / 500 AS z,
  signal / 100 AS t0, frame_idx / 10 AS t1, sin(signal) AS t2 FROM frames),
p AS (SELECT episode, frame_idx, kept, t0, t1, t2, cos(z) * cos(y) AS r0, cos(z) * sin(y) * sin(x) - sin(z) * cos(x) AS r1, cos(z) * sin(y) * cos(x) + sin(z) * sin(x) AS r2,
  sin(z) * cos(y) AS r3, sin(z) * sin(y) * sin(x) + cos(z) * cos(x) AS r4, sin(z) * sin(y) * cos(x) - cos(z) * sin(x) AS r5, -sin(y) AS r6, cos(y) * sin(x) AS r7, cos(y) * cos(x) AS r8 FROM e)"""
COLUMNS = [f"r{i}" for i in range(9)] + ["t0", "t1", "t2"]


def nine(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(9)]


def flipped(m: list[str]) -> list[str]:
    return [m[c * 3 + r] for r in range(3) for c in range(3)]


def times(a: list[str], b: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{a[r * 3 + k]} * {b[k * 3 + c]}" for k in range(3)) + ")" for r in range(3) for c in range(3)]


def turned(m: list[str]) -> list[str]:
    """Euler angles of a matrix, in SQL."""
    return [f"atan2({m[7]}, {m[8]})", f"-asin(greatest(least({m[6]}, 1), -1))", f"atan2({m[3]}, {m[0]})"]


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0"


NEXT = f"{POSES}, q AS (SELECT *, {', '.join(f'lead({c}) OVER w AS n_{c}' for c in [*COLUMNS, 'kept'])}, {', '.join(f'lag({c}) OVER w AS b_{c}' for c in COLUMNS)} FROM p WINDOW w AS (PARTITION BY episode ORDER BY frame_idx))"
BACK = times(flipped(nine("b_r")), nine("r"))


@query(f"""WITH {NEXT}, m AS (SELECT episode, {', '.join(f'{x} AS m{i}' for i, x in enumerate(BACK))}, sqrt((t0 - b_t0) ** 2 + (t1 - b_t1) ** 2 + (t2 - b_t2) ** 2) AS d FROM q)
SELECT episode, round(coalesce(sum(degrees(atan2(sqrt((m7 - m5) ** 2 + (m2 - m6) ** 2 + (m3 - m1) ** 2), m0 + m4 + m8 - 1))), 0), 5) AS rotation, round(coalesce(sum(d), 0), 5) AS distance FROM m GROUP BY episode""")
def camera_metrics(spark, sf):
    return motion.camera_metrics(poses(spark, sf)).select("episode", F.round("rotation", 5).alias("rotation"), F.round("distance", 5).alias("distance"))


WORLD = times(nine("r"), nine("r"))


@query(f"""WITH {POSES} SELECT episode, frame_idx, {', '.join(rounded(f'CASE WHEN kept THEN r{3 * i} * t0 + r{3 * i + 1} * t1 + r{3 * i + 2} * t2 + t{i} ELSE t{i} END') + f' AS t{i}' for i in range(3))},
  {', '.join(rounded(f'CASE WHEN kept THEN {WORLD[i]} ELSE r{i} END') + f' AS r{i}' for i in (0, 4, 8))} FROM p""")
def world_poses(spark, sf):
    own = poses(spark, sf)
    out = motion.to_world(own, own.filter("kept"))
    return out.select("episode", "frame_idx", *[F.round(F.get("t", i), 6).alias(f"t{i}") for i in range(3)], *[F.round(F.get("r", i), 6).alias(f"r{i}") for i in (0, 4, 8)])


STEP = turned(times(nine("n_r"), flipped(nine("r"))))
VALID = "(kept AND coalesce(n_kept, false))"


@query(f"""WITH {NEXT} SELECT episode, frame_idx, {VALID} AS valid, {', '.join(rounded(f'CASE WHEN {VALID} THEN n_t{i} - t{i} ELSE 0 END') + f' AS d{i}' for i in range(3))},
  {', '.join(rounded(f'CASE WHEN {VALID} THEN {x} ELSE 0 END') + f' AS e{i}' for i, x in enumerate(STEP))} FROM q""")
def relative_poses(spark, sf):
    out = motion.relative_steps(poses(spark, sf))
    return out.select("episode", "frame_idx", "valid", *[F.round(F.get("dt", i), 6).alias(f"d{i}") for i in range(3)], *[F.round(F.get("turn", i), 6).alias(f"e{i}") for i in range(3)])


FAR = turned(times(nine("b.r"), flipped(nine("a.r"))))


@query(f"""WITH {POSES} SELECT a.episode, a.frame_idx AS anchor, b.frame_idx, a.kept AND b.kept AS valid,
  {', '.join(rounded(f'CASE WHEN a.kept AND b.kept THEN b.t{i} - a.t{i} ELSE 0 END') + f' AS d{i}' for i in range(3))},
  {', '.join(rounded(f'CASE WHEN a.kept AND b.kept THEN {x} ELSE 0 END') + f' AS e{i}' for i, x in enumerate(FAR))}
FROM p a JOIN p b ON a.episode = b.episode AND b.frame_idx BETWEEN a.frame_idx + 1 AND a.frame_idx + 4""")
def anchored_poses(spark, sf):
    out = motion.relative_to_anchor(poses(spark, sf), 4)
    return out.select("episode", "anchor", "frame_idx", "valid", *[F.round(F.get("dt", i), 6).alias(f"d{i}") for i in range(3)], *[F.round(F.get("turn", i), 6).alias(f"e{i}") for i in range(3)])


@query(f"""WITH {POSES}, n AS (SELECT episode, max(frame_idx) AS last FROM p GROUP BY episode)
SELECT a.episode, a.frame_idx, {', '.join(rounded(f'b.{c}') + f' AS {c}' for c in ('t0', 't1', 't2', 'r0', 'r4', 'r8'))}
FROM p a JOIN n ON n.episode = a.episode JOIN p b ON b.episode = a.episode AND b.frame_idx = least(a.frame_idx + 8, n.last)""")
def rebuilt_poses(spark, sf):
    """Relative actions of eight steps, integrated again: the pose reached is that of the eighth next frame."""
    own = poses(spark, sf).withColumn("kept", F.lit(True))
    chunks = motion.action_chunks(motion.relative_steps(own), 8)
    end = F.element_at(motion.reached(F.col("r"), F.col("t"), F.col("chunk")), -1)
    out = chunks.select("episode", "frame_idx", end.alias("end"))
    return out.select("episode", "frame_idx", *[F.round(F.get("end.t", i), 6).alias(f"t{i}") for i in range(3)], *[F.round(F.get("end.r", i), 6).alias(f"r{i}") for i in (0, 4, 8)])


MIRROR = [str(x) for x in (-1, 0, 0, 0, 1, 0, 0, 0, 1)]
VIEW = times(times(flipped(nine("r")), nine("r")), MIRROR)
SEEN = times(times(nine("r"), nine("r")), flipped(nine("r")))


@query(f"""WITH {POSES} SELECT episode, frame_idx, {', '.join(rounded(VIEW[i]) + f' AS v{i}' for i in (0, 4, 8))}, {', '.join(rounded(SEEN[i]) + f' AS s{i}' for i in (1, 5, 6))},
  {rounded('r2 + 10 * t0 + 100 * t2')} AS h FROM p""")
def mirrored_views(spark, sf):
    """A rotation under a changed, mirrored view, a step under one, and three numbers of the homogeneous form."""
    r, back = F.col("r"), g.transposed(F.col("r"))
    view, seen, h = g.changed_view(r, back, F.array(*[F.lit(float(x)) for x in MIRROR])), g.changed_step(r, r), g.homogeneous(r, F.col("t"))
    out = poses(spark, sf).select("episode", "frame_idx", view.alias("v"), seen.alias("s"), h.alias("h"))
    total = F.get("h", 2) + 10 * F.get("h", 3) + 100 * F.get("h", 11)
    return out.select("episode", "frame_idx", *[F.round(F.get("v", i), 6).alias(f"v{i}") for i in (0, 4, 8)], *[F.round(F.get("s", i), 6).alias(f"s{i}") for i in (1, 5, 6)], F.round(total, 6).alias("h"))


@query(f"""WITH {POSES} SELECT episode, frame_idx, round_even((1.1 * (t0 / greatest(t2, 0.05)) + 0.5) * 640, 0)::INT AS u, round_even((0.9 * (t1 / greatest(t2, 0.05)) + 0.5) * 480, 0)::INT AS v FROM p""")
def projected_points(spark, sf):
    k = g.camera(F.lit(1.1), F.lit(0.9), F.lit(0.5), F.lit(0.5))
    return poses(spark, sf).select("episode", "frame_idx", g.projected(F.col("t"), k, F.lit(480), F.lit(640)).alias("p")).select("episode", "frame_idx", "p.u", "p.v")


@query("""WITH k AS (SELECT p_partkey, 500.0::DOUBLE + p_size AS fx, 480.0::DOUBLE + p_size AS fy, 300.0::DOUBLE + p_size AS cx, 200.0::DOUBLE + p_size AS cy FROM part)
SELECT p_partkey, round(fx * 0.5, 6) AS crop_fx, round((cx - 56) * 0.5, 6) AS crop_cx, round(fy * (224 / (2 * cy)), 6) AS resize_fy, round(cx * (320 / (2 * cx)), 6) AS resize_cx,
  round(fx / (cx * 2), 6) AS share_fx, round(cy / (cy * 2), 6) AS share_cy FROM k""")
def changed_cameras(spark, sf):
    k = g.camera(500.0 + F.col("p_size"), 480.0 + F.col("p_size"), 300.0 + F.col("p_size"), 200.0 + F.col("p_size"))
    own = table(spark, sf, "part").select("p_partkey", k.alias("k"))
    crop, resize, share = g.cropped_camera(F.col("k"), F.lit(560), F.lit(448), F.lit(224)), g.resized_camera(F.col("k"), F.lit(224), F.lit(320)), g.normalised_camera(F.col("k"))
    picks = {"crop_fx": (crop, 0), "crop_cx": (crop, 2), "resize_fy": (resize, 4), "resize_cx": (resize, 2), "share_fx": (share, 0), "share_cy": (share, 5)}
    return own.select("p_partkey", *[F.round(F.get(m, i), 6).alias(name) for name, (m, i) in picks.items()])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_discount WHEN 1 THEN l_quantity * 20 ELSE l_extendedprice END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, v, round_even(greatest(0, least(639.0, CASE WHEN abs(v) <= 1 THEN v * 640 WHEN abs(v) <= 1000 THEN v / 1000 * 640 ELSE v END)), 0)::INT AS pixel FROM c""")
def model_coordinates(spark, sf):
    v = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount")).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity") * 20).otherwise(F.col("l_extendedprice"))
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return own.withColumn("pixel", g.coordinate(F.col("v"), F.lit(640), F.col("v")))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least((l_partkey % 900)::INT, 640 - greatest(40, (l_quantity * 8)::INT))) AS x1, greatest(0, least((l_suppkey % 900)::INT, 480 - greatest(40, (l_quantity * 6)::INT))) AS y1,
  greatest(40, (l_quantity * 8)::INT) AS w, greatest(40, (l_quantity * 6)::INT) AS h FROM lineitem""")
def fitted_boxes(spark, sf):
    box = g.fitted_box(F.col("l_partkey") % 900, F.col("l_suppkey") % 900, F.col("l_quantity") * 8, F.col("l_quantity") * 6, F.lit(640), F.lit(480), 40)
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).filter("b IS NOT NULL")
    return out.select("l_orderkey", "l_linenumber", "b.x1", "b.y1", (F.col("b.x2") - F.col("b.x1")).alias("w"), (F.col("b.y2") - F.col("b.y1")).alias("h"))


@query("""SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN embedding[33] ELSE embedding[1] END::DOUBLE, 6) AS first, round(CASE WHEN label % 2 = 0 THEN embedding[1] ELSE embedding[33] END::DOUBLE, 6) AS middle FROM embeddings""")
def mirrored_vectors(spark, sf):
    x = g.swapped_halves(F.col("embedding").cast("array<double>"), F.col("label") % 2 == 0)
    return table(spark, sf, "embeddings").select("vec_id", x.alias("x")).select("vec_id", F.round(F.get("x", 0), 6).alias("first"), F.round(F.get("x", 32), 6).alias("middle"))


@query(f"""WITH {FRAMES}, d AS (SELECT episode, frame_idx, signal, frame_idx % 16 AS step FROM frames WHERE frame_idx % 16 < 12),
b AS (SELECT *, lag(signal) OVER (PARTITION BY episode ORDER BY frame_idx) AS before FROM d)
SELECT episode, frame_idx, round(CASE WHEN step = 0 AND before IS NOT NULL THEN 0.4 * before + 0.6 * signal ELSE signal END, 6) AS executed FROM b""")
def executed_steps(spark, sf):
    return motion.executed(frames(spark, sf), 16, 12).select("episode", "frame_idx", F.round("executed", 6).alias("executed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN avg(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0 END) OVER (PARTITION BY l_orderkey) < 0.5 THEN 'left' ELSE 'right' END AS side FROM lineitem""")
def track_sides(spark, sf):
    return motion.track_sides(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "side")


@query(f"""WITH {FRAMES}, s AS (SELECT episode, arg_min(signal, frame_idx) AS first_shape FROM frames WHERE event_type = 'signup' GROUP BY episode)
SELECT episode, frame_idx, event_type <> 'error' AS kept, CASE WHEN event_type <> 'error' THEN signal ELSE 0 END AS signal, first_shape FROM frames LEFT JOIN s USING (episode)""")
def aligned_frames(spark, sf):
    own = frames(spark, sf)
    lengths = own.groupBy("episode").agg(F.count("*").alias("n"))
    records = own.filter("event_type <> 'error'").withColumn("shape", F.when(F.col("event_type") == "signup", F.col("signal")))
    return motion.aligned(records, lengths)


SIZES = f"{FRAMES}, n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode)"


def sizes(spark, sf):
    return frames(spark, sf).groupBy("episode").agg(F.count("*").alias("n"))


@query(f"WITH {SIZES} SELECT episode, i AS slot, round_even(i * n / 9, 0)::BIGINT AS frame_idx FROM n, range(1, 9) t(i)")
def interior_frames(spark, sf):
    return motion.nearby(sizes(spark, sf), "interior", 8).select("episode", F.col("slot").cast("long").alias("slot"), "frame_idx")


@query(f"""WITH {SIZES}, f AS (SELECT episode, n, CASE WHEN n > 8 THEN ({sql_draw('episode')} * (n - 8)) >> 32 ELSE 0 END AS first FROM n)
SELECT episode, i AS slot, first + i - 1 AS frame_idx FROM f, range(1, 9) t(i) WHERE i <= n""")
def block_of_frames(spark, sf):
    return motion.nearby(sizes(spark, sf), "block", 8, draws.draw(SEED, F.col("episode"))).select("episode", "slot", "frame_idx")


@query(f"""WITH {SIZES}, d AS (SELECT episode, i AS frame_idx, row_number() OVER (PARTITION BY episode ORDER BY {sql_draw('episode', 'i')}, i) AS slot FROM n, unnest(range(n)) t(i))
SELECT episode, slot, frame_idx FROM d WHERE slot <= 8""")
def distinct_frames(spark, sf):
    out = motion.nearby(sizes(spark, sf), "distinct", 8, draws.draw(SEED, F.col("episode"), F.col("frame_idx")))
    return out.select("episode", F.col("slot").cast("long").alias("slot"), "frame_idx")


@query(f"""WITH {NEXT} SELECT episode, frame_idx, {rounded('coalesce(sqrt((t0 - b_t0) ** 2 + (t1 - b_t1) ** 2 + (t2 - b_t2) ** 2), 0)')} AS speed FROM q""")
def vector_speed(spark, sf):
    moved = g.norm(g.minus(F.col("t"), F.lag("t").over(episodes.by_frame())))
    return poses(spark, sf).select("episode", "frame_idx", F.round(F.coalesce(moved, F.lit(0.0)), 6).alias("speed"))
