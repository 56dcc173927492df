"""Objects of a scene: placement relations, catalogue unions, duplicates, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field(box: str, name: str) -> Column:
    return F.col(f"{box}.{name}")


def shared_area(a: str, b: str) -> Column:
    """Area of the intersection of two boxes (x, y, w, h)."""

    def span(p: str, q: str) -> Column:
        low = F.greatest(field(a, p), field(b, p))
        return F.greatest(F.least(field(a, p) + field(a, q), field(b, p) + field(b, q)) - low, F.lit(0.0))

    return span("x", "w") * span("y", "h")


def rests_on(inner: str, outer: str, margin: float = 35, share: float = 0.2) -> Column:
    """The centre of `inner` within `outer` widened by a margin, and a fifth of its area shared."""

    def inside(p: str, q: str) -> Column:
        centre = field(inner, p) + field(inner, q) / 2
        return (centre >= field(outer, p) - margin) & (centre <= field(outer, p) + field(outer, q) + margin)

    return inside("x", "w") & inside("y", "h") & (shared_area(inner, outer) >= share * field(inner, "w") * field(inner, "h"))


def gaps(a: str, b: str) -> tuple[Column, Column]:
    """The distances of two boxes along x and along y; 0 where they overlap on that axis."""

    def along(p: str, q: str) -> Column:
        return F.greatest(field(a, p) - field(b, p) - field(b, q), field(b, p) - field(a, p) - field(a, q), F.lit(0.0))

    return along("x", "w"), along("y", "h")


def adjacent(a: str, b: str, near: float = 90, share: float = 0.15) -> Column:
    """The smaller gap under `near`, and at most `share` of the smaller box overlapped."""

    def area(box: str) -> Column:
        return F.greatest(field(box, "w"), F.lit(0.0)) * F.greatest(field(box, "h"), F.lit(0.0))

    return (F.least(*gaps(a, b)) < near) & (shared_area(a, b) <= share * F.least(area(a), area(b)))


def feasibility(facts: dict[str, Column]) -> Column:
    """Points of an instruction for a scene, from what is known of both (boolean columns).

    both_hands: valid for two hands; holding: a hand of the scene holds something; grasps_held: grasps
    what is held; operates_held: works with it; uses: its verb is use; puts_down: puts something down;
    primary_held, involves_held: its first, any object is held; lays: its verb is one of putting down;
    two_objects: of that kind.
    """
    held = F.when(facts["grasps_held"], -100).when(facts["operates_held"], 40 + F.when(facts["uses"], 20).otherwise(0))
    held = held.when(facts["puts_down"] & facts["primary_held"], 18).when(facts["primary_held"], 8).when(facts["involves_held"], 4).otherwise(-100)
    scene = F.when(facts["holding"], held).when(facts["lays"], 4).otherwise(0)
    return F.when(facts["both_hands"], 50).otherwise(0) + scene + F.when(facts["two_objects"], 3).otherwise(0)


def without_known(suggested: DataFrame, known: DataFrame, scene: str, key: str, order: str) -> DataFrame:
    """Suggested objects whose key is not among the scene's known ones, the first of each key."""
    fresh = suggested.join(known.select(scene, key).distinct(), [scene, key], "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(scene, key).orderBy(order))).filter("_r = 1").drop("_r")


def distinct_by_class(objects: DataFrame, scene: str, key: str, priority: str, order: str) -> DataFrame:
    """One object of each key in a scene: the one of the best class."""
    w = Window.partitionBy(scene, key).orderBy(priority, order)
    return objects.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
