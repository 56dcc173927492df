"""Queries over robot and human layouts: vectors of `embeddings` as states, poses of `events` as a robot's hands, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import robot
from reelspan.operators.episodes import by_frame
from reelspan.plans.motion import flipped, nine, rounded, times, turned
from reelspan.plans.queries import FRAMES, frames, query
from reelspan.plans.windows import _matrix, named, weighted
from reelspan.sources.tables import table


def vectors(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
#: Numbers of a human hand beside those of the robot's, counted from 1 in 24 and 102 numbers.
HUMAN = "(27, 7), (36, 8), (18, 9), (9, 10), (48, 11), (43, 12)"
PLACES = f"""p AS (SELECT i AS h, i AS r FROM range(1, 7) t(i) UNION ALL SELECT 51 + i, 12 + i FROM range(1, 7) t(i)
  UNION ALL SELECT * FROM (VALUES {HUMAN}) f(h, r) UNION ALL SELECT 51 + h, 12 + r FROM (VALUES {HUMAN}) f(h, r))"""


@query(f"""WITH {V}, {PLACES}, pairs AS (SELECT h, r FROM p UNION ALL SELECT h + 3, r FROM p WHERE r NOT BETWEEN 1 AND 6 AND r NOT BETWEEN 13 AND 18 AND (h - 1) % 51 + 3 BETWEEN 6 AND 50)
SELECT vec_id, round(sum(x[r] * h), 6) AS total, round(sum(CASE WHEN h > 51 THEN x[r] ELSE 0 END), 6) + 0 AS right_hand, 102::BIGINT AS numbers FROM v, pairs GROUP BY vec_id""")
def robot_as_human(spark, sf):
    """A robot's 24 numbers as 102 of two human hands, with the joints that aren't driven."""
    rows = vectors(spark, sf).withColumn("h", robot.with_passive_joints(robot.to_human(F.col("x")), 102))
    right = F.aggregate(F.slice("h", 52, 51), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(weighted(F.col("h"), 0, 102), 6).alias("total"), F.round(right, 6).alias("right_hand"), F.size("h").cast("long").alias("numbers"))


@query(f"WITH {V} SELECT vec_id, round(list_sum([x[i] * i for i in range(1, 25)]), 6) AS total, 24::BIGINT AS numbers FROM v")
def human_as_robot(spark, sf):
    """There and back again: a robot's numbers by way of the human layout of 192."""
    back = robot.to_robot(robot.to_human(F.col("x"), 192))
    return vectors(spark, sf).withColumn("r", back).select("vec_id", F.round(weighted(F.col("r"), 0, 24), 6).alias("total"), F.size("r").cast("long").alias("numbers"))


@query(f"""WITH {V} SELECT vec_id, (6 + CASE WHEN label % 2 = 0 THEN 45 ELSE 0 END + CASE WHEN label % 3 = 0 THEN 3 ELSE 0 END)::BIGINT AS known,
  round(list_sum([x[i] * i for i in range(1, 7)]) + CASE WHEN label % 2 = 0 THEN list_sum([x[6 + i] * (57 + i) for i in range(1, 46)]) ELSE 0 END + CASE WHEN label % 3 = 0 THEN x[62] * 52 + x[63] * 53 + x[64] * 54 ELSE 0 END, 6) AS total,
  array_to_string(list_sort(['HUMAN_LEFT_6D', 'HUMAN_LEFT_HAND', 'HUMAN_LEFT_ROT', 'HUMAN_LEFT_TRANS'] || CASE WHEN label % 2 = 0 THEN ['HUMAN_RIGHT_HAND', 'HUMAN_RIGHT_JOINTS'] ELSE [] END
    || CASE WHEN label % 3 = 0 THEN ['HUMAN_RIGHT_6D', 'HUMAN_RIGHT_TRANS'] || CASE WHEN label % 2 = 0 THEN [] ELSE ['HUMAN_RIGHT_HAND'] END ELSE [] END), ',') AS parts,
  (9 + 3 + 6 - 6 + CASE WHEN label % 2 = 0 THEN 90 ELSE 0 END + CASE WHEN label % 3 = 0 THEN 9 ELSE 0 END + 6)::BIGINT AS given FROM v""")
def named_parts(spark, sf):
    """Named parts into one vector of 192 with its mask, and the parts that can be read back from it."""
    x = F.col("x")
    parts = {"HUMAN_LEFT_6D": F.slice(x, 1, 6), "HUMAN_RIGHT_JOINTS": F.when(F.col("label") % 2 == 0, F.slice(x, 7, 45)), "HUMAN_RIGHT_TRANS": F.when(F.col("label") % 3 == 0, F.slice(x, 62, 3))}
    vector, mask = robot.scattered(parts, robot.ACTION_PARTS, 192)
    rows = vectors(spark, sf).select("vec_id", vector.alias("a"), mask.alias("m")).withColumn("g", robot.gathered(F.col("a"), F.col("m"), robot.ACTION_PARTS))
    sizes = F.aggregate(F.transform(F.map_values("g"), lambda p: F.size(p).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select(
        "vec_id", F.size(F.filter("m", lambda m: m)).cast("long").alias("known"), F.round(weighted(F.col("a"), 0, 192), 6).alias("total"),
        F.array_join(F.array_sort(F.map_keys("g")), ",").alias("parts"), sizes.alias("given"),
    )


@query(f"""WITH {V}, m AS (SELECT label, i, avg(x[(i - 1) % 64 + 1]) AS mean, stddev_pop(x[(i - 1) % 64 + 1]) AS std FROM v, range(1, 123) t(i) GROUP BY label, i)
SELECT vec_id, round(sum(k * ((x[(k - 1) % 64 + 1] - mean) / (std + 1e-7))), 5) AS total FROM v JOIN m USING (label), range(1, 103) s(k) WHERE i = CASE WHEN k <= 51 THEN k ELSE k + 10 END GROUP BY vec_id""")
def normalised_humans(spark, sf):
    """102 numbers by their label's statistics of 122, which hold ten numbers of shape after each hand."""
    rows = vectors(spark, sf)
    wide = F.transform(F.sequence(F.lit(0), F.lit(121)), lambda i: F.get("x", i % 64))
    each = rows.select("label", F.posexplode(wide).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    held = each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "mean", "std"))).alias("s"))  # 122 numbers a label
    state = F.transform(F.sequence(F.lit(0), F.lit(101)), lambda i: F.get("x", i % 64))
    done = rows.join(held, "label").select("vec_id", robot.normalised_human(state, F.col("s.mean"), F.col("s.std")).alias("n"))
    return done.select("vec_id", F.round(weighted(F.col("n"), 0, 102), 5).alias("total"))


def robots(spark, sf: str) -> DataFrame:
    """A robot's state in its base for each frame, the right hand from half the signal, and which hands are there."""
    s = F.col("signal")

    def own(s: Column) -> Column:
        return F.array(s / 100, F.col("frame_idx") / 10, F.sin(s), 0.3 * F.sin(s), 0.2 * F.cos(s), s / 500, *[(F.sin(s + i) + 1) / 2 for i in range(6)])

    mask = F.array(F.col("event_type") != "error", F.col("event_type") != "signup")
    return frames(spark, sf).select("episode", "frame_idx", F.concat(own(s), own(s / 2 + 1)).alias("state"), mask.alias("mask"))


ROBOTS = f"""{FRAMES}, hands AS (SELECT episode, frame_idx, 'left' AS hand, signal AS s, event_type <> 'error' AS there FROM frames UNION ALL SELECT episode, frame_idx, 'right', signal / 2 + 1, event_type <> 'signup' FROM frames),
base AS (SELECT episode, frame_idx, hand, there, s, s / 100 AS t0, frame_idx / 10 AS t1, sin(s) AS t2, {named(_matrix("0.3 * sin(s)", "0.2 * cos(s)", "s / 500"), "r")} FROM hands),
mount AS (SELECT 0::DOUBLE AS c0, -sin(0.8307767239493009::DOUBLE) AS c1, cos(0.8307767239493009::DOUBLE) AS c2, -1::DOUBLE AS c3, 0::DOUBLE AS c4, 0::DOUBLE AS c5,
  0::DOUBLE AS c6, -cos(0.8307767239493009::DOUBLE) AS c7, -sin(0.8307767239493009::DOUBLE) AS c8, 0.05366::DOUBLE AS o0, 0.01753::DOUBLE AS o1, 0.47387::DOUBLE AS o2)"""
#: A rotation whose first two columns change sign.
TURNED = ["-1", "-1", "1"] * 3
IN_CAMERA = [f"{a} * {b}" for a, b in zip(times(flipped(nine("c")), nine("r")), TURNED, strict=True)]
MOVED = [f"c{i} * (t0 - o0) + c{3 + i} * (t1 - o1) + c{6 + i} * (t2 - o2)" for i in range(3)]
JOINTS = " + ".join(f"{i + 1} * ({high} - (sin(s + {i}) + 1) / 2 * ({high} - {low}))" for i, (low, high) in enumerate((("0.0", "1.7"), ("0.0", "1.7"), ("0.0", "1.7"), ("0.0", "1.7"), ("0.0", "0.5"), ("-0.1", "1.3"))))


def by_hand(rows: DataFrame, column: str, width: int) -> DataFrame:
    each = [F.struct(F.lit(s).alias("hand"), F.slice(column, i * width + 1, width).alias("x")) for i, s in enumerate(("left", "right"))]
    return rows.select("episode", "frame_idx", F.explode(F.array(*each)).alias("h")).select("episode", "frame_idx", "h.hand", "h.x")


@query(f"""WITH {ROBOTS} SELECT episode, frame_idx, hand, {", ".join(rounded(f"CASE WHEN there THEN {x} ELSE 0 END") + f" AS x{i}" for i, x in enumerate([*MOVED, *turned(IN_CAMERA)]))},
  round(CASE WHEN there THEN {JOINTS} ELSE 0 END, 6) AS joints FROM base, mount""")
def robot_camera_states(spark, sf):
    """Robot states as the robot's camera sees them."""
    out = robots(spark, sf).select("episode", "frame_idx", robot.camera_state(F.col("state"), F.col("mask")).alias("x"))
    return by_hand(out, "x", 12).select("episode", "frame_idx", "hand", *[F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(6)], F.round(weighted(F.col("x"), 6, 6), 6).alias("joints"))


@query(f"""WITH {ROBOTS} SELECT episode, frame_idx, hand, {", ".join(rounded(f"CASE WHEN there THEN t{i} ELSE 0 END") + f" AS t{i}" for i in range(3))},
  {", ".join(rounded(f"CASE WHEN there THEN r{i} ELSE 0 END") + f" AS r{i}" for i in range(9))}, CASE WHEN there THEN 1::DOUBLE ELSE 0 END AS one, round(CASE WHEN there THEN {JOINTS} ELSE 0 END, 6) AS joints FROM base""")
def robot_actions(spark, sf):
    """Robot states by way of the camera's frame to 44 numbers of an action: the poses come back."""
    seen = robots(spark, sf).select("episode", "frame_idx", robot.camera_state(F.col("state"), F.col("mask")).alias("x"), "mask")
    rows = by_hand(seen.withColumn("x", robot.robot_action(F.col("x"), F.col("mask"))), "x", 22)
    cells = [(4 * r + c, f"r{3 * r + c}") for r in range(3) for c in range(3)] + [(4 * r + 3, f"t{r}") for r in range(3)]
    return rows.select("episode", "frame_idx", "hand", *[F.round(F.get("x", i), 6).alias(n) for i, n in cells], F.round(F.get("x", 15), 6).alias("one"), F.round(weighted(F.col("x"), 16, 6), 6).alias("joints"))


@query(f"""WITH {ROBOTS}, n AS (SELECT *, {", ".join(f"lead({c}) OVER w AS n_{c}" for c in [*nine("r"), "t0", "t1", "t2", "s"])} FROM base WINDOW w AS (PARTITION BY episode, hand ORDER BY frame_idx))
SELECT episode, frame_idx, hand, {", ".join(rounded(x) + f" AS x{i}" for i, x in enumerate([*[f"n_t{i} - t{i}" for i in range(3)], *turned(times(nine("n_r"), flipped(nine("r"))))]))},
  round({" + ".join(f"{i + 1} * ((sin(n_s + {i}) + 1) / 2)" for i in range(6))}, 6) AS joints FROM n WHERE n_s IS NOT NULL""")
def robot_steps(spark, sf):
    """Moves between a robot's frames, with the joints of the next one."""
    rows = robots(spark, sf).withColumn("then", F.lead("state").over(by_frame())).filter("then IS NOT NULL")
    out = by_hand(rows.withColumn("x", robot.relative_action(F.col("state"), F.col("then"))), "x", 12)
    return out.select("episode", "frame_idx", "hand", *[F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(6)], F.round(weighted(F.col("x"), 6, 6), 6).alias("joints"))


YAW = ["cos(a)", "-sin(a)", "0", "sin(a)", "cos(a)", "0", "0", "0", "1"]
ROLL = ["1", "0", "0", "0", "cos(b)", "-sin(b)", "0", "sin(b)", "cos(b)"]
LEAN = ["cos(c)", "0", "sin(c)", "0", "1", "0", "-sin(c)", "0", "cos(c)"]


@query(f"""WITH w AS (SELECT p_partkey, p_size / 50 AS a, p_size / 40 - 0.5 AS b, 0.3 - p_size / 60 AS c, 0.8307767239493009::DOUBLE AS k FROM part),
x AS (SELECT *, {named(YAW, "y")}, {named(ROLL, "o")}, {named(LEAN, "l")} FROM w), u AS (SELECT *, {named(times(nine("y"), nine("o")), "u")} FROM x), z AS (SELECT *, {named(times(nine("u"), nine("l")), "z")} FROM u)
SELECT p_partkey, {", ".join(rounded(f"y{3 * i} * -0.0039635 + y{3 * i + 2} * 0.044 + z{3 * i} * 0.0576235 + z{3 * i + 1} * 0.01753 + z{3 * i + 2} * 0.42987") + f" AS t{i}" for i in range(3))},
  {", ".join(rounded(x) + f" AS r{3 * i + j}" for i in range(3) for j, x in enumerate((f"-z{3 * i + 1}", f"-(z{3 * i} * sin(k) + z{3 * i + 2} * cos(k))", f"z{3 * i} * cos(k) - z{3 * i + 2} * sin(k)")))} FROM z""")
def mounted_cameras(spark, sf):
    """The camera of a robot whose waist is turned, leaned and bent."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", robot.camera_pose(size / 50, size / 40 - 0.5, 0.3 - size / 60).alias("c"))
    return rows.select("p_partkey", *[F.round(F.get("c.t", i), 6).alias(f"t{i}") for i in range(3)], *[F.round(F.get("c.r", i), 6).alias(f"r{i}") for i in range(9)])
