"""Ordered acceptance under several caps at once: what a scene's instructions may repeat, and how many come from which pool.

A scene's candidates are folded in their order, since what may still be taken hangs on all that was
taken before, which no rank over a window can see. A scene is one row while it is folded: its pool is what a model
proposed for one image, some dozens of candidates, and the work of a fold is the square of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How often these verbs may lead a scene's instructions; any other verb may once.
VERB_CAPS = {"place": 1, "put": 1, "rotate": 1}
TAKEN = "struct<ids:array<long>,keys:array<string>,tags:array<string>,phases:array<int>>"


def cap_of(tag: Column, caps: dict[str, int], default: int) -> Column:
    found = F.lit(default)
    for name, cap in caps.items():
        found = F.when(tag == name, cap).otherwise(found)
    return found


def takes(items: Column, start: Column, quotas: Column, total: Column, caps: dict[str, int], default: int = 1) -> Column:
    """Folds items (id, key, tags, phase), in order, from what `start` has taken.

    An item is taken if its phase has room (`quotas` by phase; the last one goes on until `total` are taken), its key is
    new, and none of its tags has been taken as often as its cap allows. Items without tags have no cap.
    """
    last = F.size(quotas) - 1

    def step(s: Column, i: Column) -> Column:
        used = F.size(F.filter(s["phases"], lambda p: p == i["phase"]))
        room = F.when(i["phase"] == last, F.size(s["ids"]) < total).otherwise(used < F.get(quotas, i["phase"]))
        full = F.exists(i["tags"], lambda t: F.size(F.filter(s["tags"], lambda x: x == t)) >= cap_of(t, caps, default))
        taken = F.struct(
            F.concat(s["ids"], F.array(i["id"])).alias("ids"),
            F.concat(s["keys"], F.array(i["key"])).alias("keys"),
            F.concat(s["tags"], i["tags"]).alias("tags"),
            F.concat(s["phases"], F.array(i["phase"])).alias("phases"),
        )
        return F.when(room & ~F.array_contains(s["keys"], i["key"]) & ~full, taken).otherwise(s)

    return F.aggregate(items, start, step)


def select_instructions(pool: DataFrame, k: int, outside: float, caps: dict[str, int] | None = None) -> DataFrame:
    """scene, place (from 0), id and phase of up to k candidates of each scene.

    `pool` has scene, id, key, tags, score, needs_edit and reserved. The best reserved candidate comes first (phase -1), then the best
    ones that need an edit of the image up to their share `outside` of the rest (phase 0), then others (1), then any (2); ties by id.
    """
    caps = VERB_CAPS if caps is None else caps
    empty = F.array().cast("array<long>"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.array().cast("array<int>")
    entry = F.struct((-F.col("score")).alias("o"), "id", "key", "tags", "needs_edit", "reserved")
    scenes = pool.groupBy("scene").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    scenes = scenes.withColumn("first", F.get(F.filter("all", lambda i: i["reserved"]), F.lit(0)))
    none = F.struct(*[e.alias(n) for e, n in zip(empty, ("ids", "keys", "tags", "phases"), strict=True)]).cast(TAKEN)
    one = F.struct(F.array("first.id").alias("ids"), F.array("first.key").alias("keys"), F.col("first.tags").alias("tags"), F.array(F.lit(-1)).alias("phases")).cast(TAKEN)
    scenes = scenes.withColumn("start", F.when(F.col("first").isNotNull(), one).otherwise(none))

    def phase(items: Column, number: int) -> Column:
        return F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["key"].alias("key"), i["tags"].alias("tags"), F.lit(number).alias("phase")))

    def edits(wanted: bool) -> Column:
        return F.filter("all", lambda i: i["needs_edit"] if wanted else ~i["needs_edit"])

    rest = k - F.size("start.ids")
    share = F.greatest(F.lit(1), F.ceil(rest * outside).cast("int")) if outside > 0 else F.lit(0)
    edited = F.least(share, rest, F.size(edits(True)))
    items = F.concat(phase(edits(True), 0), phase(edits(False), 1), phase(F.col("all"), 2))
    done = scenes.withColumn("taken", takes(items, F.col("start"), F.array(edited, rest - edited, F.lit(k)), F.lit(k), caps))
    each = F.posexplode(F.arrays_zip(F.col("taken.ids").alias("id"), F.col("taken.phases").alias("phase"))).alias("place", "t")
    return done.select("scene", each).select("scene", "place", "t.id", "t.phase").filter(F.col("place") < k)


def bounded_pools(pool: DataFrame, most: int) -> DataFrame:
    """Scenes whose pools hold more than `most` candidates, with their sizes: such a pool is no scene's, and is worth a look before it is folded."""
    return pool.groupBy("scene").agg(F.count("*").alias("candidates")).filter(F.col("candidates") > most)
