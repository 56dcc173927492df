"""Named parts of flat vectors, and the layouts of a robot's two hands and of human hands, as Column formulas.

A robot's state has for each hand, left first, place (3), Euler angles (3) and six finger joints; a human
one place, angles and 45 finger angles. Poses are a rotation (nine numbers by rows) and a translation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions import geometry as g

#: Parts of action vectors as first and last + 1 number; states hold two more.
ACTION_PARTS = {
    "HUMAN_LEFT_HAND": (0, 51), "HUMAN_RIGHT_HAND": (51, 102), "HUMAN_LEFT_TRANS": (0, 3), "HUMAN_LEFT_ROT": (3, 6), "HUMAN_LEFT_6D": (0, 6),
    "HUMAN_LEFT_JOINTS": (6, 51), "HUMAN_RIGHT_TRANS": (51, 54), "HUMAN_RIGHT_ROT": (54, 57), "HUMAN_RIGHT_6D": (51, 57), "HUMAN_RIGHT_JOINTS": (57, 102), "PADDING_FEATURES": (102, 192),
}
STATE_PARTS = ACTION_PARTS | {"HUMAN_LEFT_BETA": (192, 202), "HUMAN_RIGHT_BETA": (202, 212)}
#: Weights of loss components for both kinds of hands (first, last + 1, weight).
LOSS = {
    "angle": {"left_hand_6d": (0, 6, 1.0), "left_hand_joints": (6, 51, 1.0), "right_hand_6d": (51, 57, 1.0), "right_hand_joints": (57, 102, 1.0)},
    "keypoints": {"left_6d": (0, 6, 1.0), "left_joints": (6, 69, 1.0), "right_6d": (51, 57, 1.0), "right_joints": (57, 120, 1.0)},
    "robot": {"left_hand_6d": (0, 6, 1.6), "left_hand_joints": (6, 51, 0.4), "right_hand_6d": (51, 57, 1.6), "right_hand_joints": (57, 102, 1.0)},
}
#: Robot finger joint, number in a human hand, sign.
FINGERS = ((0, 26, 1), (1, 35, 1), (2, 17, 1), (3, 8, 1), (4, 47, 1), (5, 42, 1))
#: Least and greatest angle of the robot's joints, which come in reverse order in a state.
LIMITS = ((-0.1, 1.3), (0.0, 0.5), (0.0, 1.7), (0.0, 1.7), (0.0, 1.7), (0.0, 1.7))
#: The camera's mount on the robot, and its optical axes (forward becomes depth).
TORSO, CAMERA, PITCH = (-0.0039635, 0.0, 0.044), (0.0576235, 0.01753, 0.42987), 0.8307767239493009
OPTICAL = (0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
ROBOT_HAND, HUMAN_HAND, WRIST, PASSIVE = 12, 51, 6, 3


def scattered(parts: dict[str, Column], layout: dict[str, tuple[int, int]], width: int) -> tuple[Column, Column]:
    """One vector of `width` numbers from named parts (arrays of any length, at the part's first place), and which of its numbers are set.

    Parts that are null set nothing; where parts overlap, the later one counts.
    """
    given = [(layout[name][0], value) for name, value in parts.items()]

    def at(i: Column) -> Column:
        value = F.lit(None).cast("double")
        for first, part in given:
            here = (i >= first) & (i < first + F.coalesce(F.size(part), F.lit(0)))
            value = F.when(here, F.coalesce(F.get(part, i - first), F.lit(0.0))).otherwise(value)
        return value

    found = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)
    return F.transform(found, lambda x: F.coalesce(x, F.lit(0.0))), F.transform(found, lambda x: x.isNotNull())


def gathered(vector: Column, mask: Column, layout: dict[str, tuple[int, int]]) -> Column:
    """A map of the parts of a vector that have any number set: as many numbers from the part's first place as are set in it."""
    entries = []
    for name, (first, end) in layout.items():
        count = F.size(F.filter(F.slice(mask, first + 1, end - first), lambda m: m))
        entries.append(F.when(count > 0, F.struct(F.lit(name), F.slice(vector, F.lit(first + 1), count))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def remapped(vector: Column, places: dict[int, tuple[int, int]], width: int) -> Column:
    """A vector of `width` numbers: number i is sign x the vector's number at places[i] = (from, sign), else 0."""
    zero = F.lit(0.0)
    return F.array(*[F.coalesce(F.get(vector, places[i][0]) * places[i][1], zero) if i in places else zero for i in range(width)])


def _human_places() -> dict[int, tuple[int, int]]:
    places = {}
    for robot, human in ((0, 0), (ROBOT_HAND, HUMAN_HAND)):
        places |= {human + i: (robot + i, 1) for i in range(WRIST)}
        places |= {human + to: (robot + WRIST + joint, sign) for joint, to, sign in FINGERS}
    return places


HUMAN_PLACES = _human_places()
ROBOT_PLACES = {source: (human, sign) for human, (source, sign) in HUMAN_PLACES.items()}


def to_human(robot: Column, width: int = 102) -> Column:
    return remapped(robot, HUMAN_PLACES, width)


def to_robot(human: Column) -> Column:
    return remapped(human, ROBOT_PLACES, 2 * ROBOT_HAND)


def human_mask(robot_mask: Column, width: int) -> Column:
    """All 51 numbers of a human hand are known where the first one of the robot's hand is."""
    hands = [F.array_repeat(F.get(robot_mask, F.lit(first)), HUMAN_HAND) for first in (0, ROBOT_HAND)]
    return F.concat(*hands, F.array_repeat(F.lit(False), width - 2 * HUMAN_HAND))


def with_passive_joints(human: Column, width: int) -> Column:
    """Each driven finger angle again three numbers further on, inside its hand."""
    places = {i: (i, 1) for i in range(width)}
    for hand in (0, HUMAN_HAND):
        places |= {hand + to + PASSIVE: (hand + to, 1) for _, to, _ in FINGERS if WRIST <= to + PASSIVE < HUMAN_HAND}
    return remapped(human, places, width)


def normalised_human(state: Column, mean: Column, std: Column, shape: int = 10) -> Column:
    """102 numbers by statistics of 122: each hand's own are followed by those of its shape."""

    def own(x: Column) -> Column:
        return F.concat(F.slice(x, 1, HUMAN_HAND), F.slice(x, HUMAN_HAND + shape + 1, HUMAN_HAND))

    return g.normalised(state, own(mean), own(std))


def joint_angles(shares: Column) -> Column:
    """Finger joints given as shares of their range, 1 for the least angle, as angles."""
    return F.array(*[F.lit(high) - F.get(shares, i) * (high - low) for i, (low, high) in enumerate(reversed(LIMITS))])


def pose(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


def composed(a: Column, b: Column) -> Column:
    """Pose b, given in a, in the frame that a is in."""
    both = F.struct(a.alias("a"), b.alias("b"))
    return g.let(both, lambda p: pose(g.product(p["a"]["r"], p["b"]["r"]), g.plus(g.rotate(p["a"]["r"], p["b"]["t"]), p["a"]["t"])))


def inverted(own: Column) -> Column:
    return g.let(own, lambda p: pose(g.transposed(p["r"]), F.transform(g.rotate(g.transposed(p["r"]), p["t"]), lambda x: -x)))


def camera_pose(yaw: Column | float = 0.0, roll: Column | float = 0.0, pitch: Column | float = 0.0) -> Column:
    """The camera's pose (r, t) in the robot's base, by the angles of its waist."""
    none = F.array(*[F.lit(0.0)] * 3)

    def about(axis: int, angle: Column | float) -> Column:
        angle = F.lit(angle) if isinstance(angle, float) else angle
        return g.from_euler(F.array(*[angle if i == axis else F.lit(0.0) for i in range(3)]))

    at = pose(about(2, yaw), none)
    for r, t in ((about(0, roll), F.array(*map(F.lit, TORSO))), (about(1, pitch), none), (about(1, PITCH), F.array(*map(F.lit, CAMERA))), (F.array(*map(F.lit, OPTICAL)), none)):
        at = composed(at, pose(r, t))
    return at


def fixed_camera() -> tuple[list[float], list[float]]:
    """The camera's pose with a straight waist, as numbers: the mount's turn about y, then the optical axes."""
    c, s = math.cos(PITCH), math.sin(PITCH)
    turn = (c, 0.0, s, 0.0, 1.0, 0.0, -s, 0.0, c)
    r = [sum(turn[3 * i + k] * OPTICAL[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return r, [a + b for a, b in zip(TORSO, CAMERA, strict=True)]


def turned_wrist(r: Column) -> Column:
    """A wrist's rotation with its first two axes turned round; its own inverse."""
    return F.array(*[g.cell(r, i, j) * (1 if j == 2 else -1) for i in range(3) for j in range(3)])


def _camera() -> Column:
    r, t = fixed_camera()
    return pose(F.array(*map(F.lit, r)), F.array(*map(F.lit, t)))


def hand_pose(state: Column, first: int) -> Column:
    """The pose of a hand whose numbers begin at `first`."""
    return pose(g.from_euler(F.slice(state, first + 4, 3)), F.slice(state, first + 1, 3))


def camera_state(state: Column, mask: Column) -> Column:
    """A robot's state of the base frame in the camera's frame, fingers as angles; hands that are masked out are zeros."""

    def hand(n: int, first: int) -> Column:
        seen = composed(inverted(_camera()), hand_pose(state, first))
        wrist = g.let(seen, lambda p: F.concat(p["t"], g.to_euler(turned_wrist(p["r"]))))
        numbers = F.concat(wrist, joint_angles(F.slice(state, first + 7, 6)))
        return F.when(F.get(mask, F.lit(n)), numbers).otherwise(F.array_repeat(F.lit(0.0), ROBOT_HAND))

    return F.concat(*[hand(n, first) for n, first in enumerate((0, ROBOT_HAND))])


def robot_action(state: Column, mask: Column) -> Column:
    """44 numbers from a state in the camera's frame: for each hand its pose in the base as sixteen numbers and its six joints."""

    def hand(n: int, first: int) -> Column:
        own = g.let(hand_pose(state, first), lambda p: pose(turned_wrist(p["r"]), p["t"]))
        numbers = F.concat(g.let(composed(_camera(), own), lambda p: g.homogeneous(p["r"], p["t"])), F.slice(state, first + 7, 6))
        return F.when(F.get(mask, F.lit(n)), numbers).otherwise(F.array_repeat(F.lit(0.0), 22))

    return F.concat(*[hand(n, first) for n, first in enumerate((0, ROBOT_HAND))])


def relative_action(now: Column, then: Column) -> Column:
    """The move between two robot states: places and turns by difference, joints as they will be."""

    def hand(first: int) -> Column:
        both = F.struct(hand_pose(now, first).alias("a"), hand_pose(then, first).alias("b"))
        wrist = g.let(both, lambda p: F.concat(g.minus(p["b"]["t"], p["a"]["t"]), g.to_euler(g.product(p["b"]["r"], g.transposed(p["a"]["r"])))))
        return F.concat(wrist, F.slice(then, first + 7, 6))

    return F.concat(hand(0), hand(ROBOT_HAND))
