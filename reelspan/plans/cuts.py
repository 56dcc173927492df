"""Queries over re-cut episodes and selected instructions, beside their SQL where that can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import text
from reelspan.operators import episodes, selection
from reelspan.plans.queries import FRAMES, frames, query
from reelspan.sources.tables import table


def recut(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes of `events` cut at one or two frames by their key, at none in every fifth."""
    own = frames(spark, sf).select("episode", "frame_idx", "signal", "event_type")
    sizes = own.groupBy("episode").agg(F.count("*").alias("n"))
    e, n = F.col("episode"), F.col("n")
    points = F.when(e % 5 == 0, F.array().cast("array<long>")).when(e % 2 == 0, F.array(F.floor(n / 3), F.floor(2 * n / 3))).otherwise(F.array(F.floor(n / 2)))
    texts = text.segment_texts(F.concat(F.lit("open box "), e.cast("string"), F.lit(" and lift the lid")), F.when(e % 2 == 0, 2).otherwise(1))
    held = sizes.select("episode", points.alias("points")), sizes.select("episode", texts.alias("texts"))
    return episodes.recut(own, *held, F.col("event_type") != "error", 0.75)


CUT = f"""{FRAMES}, n AS (SELECT episode, count(*) AS n, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) >= 0.75 AND episode % 5 <> 0 AS kept, episode % 2 = 0 AS twice FROM frames GROUP BY episode),
e AS (SELECT *, CASE WHEN twice THEN [0, n // 3, 2 * n // 3, n - 1] ELSE [0, n // 2, n - 1] END AS edges FROM n WHERE kept),
s AS (SELECT episode, i - 1 AS segment, edges[i] AS start_, edges[i + 1] AS end_, CASE WHEN i = 1 THEN 'open box ' || episode WHEN i = 2 AND twice THEN 'lift it' ELSE 'return home' END AS text FROM e, unnest(range(1, len(edges))) r(i)),
d AS (SELECT *, row_number() OVER (ORDER BY episode, segment) - 1 AS new_episode FROM s)"""


@query(f"WITH {CUT} SELECT episode, segment::INT AS segment, start_ AS first_frame, end_ AS last_frame, end_ - start_ + 1 AS frames, text, new_episode FROM d")
def recut_segments(spark, sf):
    out = recut(spark, sf)[0]
    return out.select("episode", "segment", F.col("start").alias("first_frame"), F.col("end").alias("last_frame"), "frames", "text", "new_episode")


@query(f"WITH {CUT} SELECT new_episode AS episode, frame_idx - start_ AS frame_idx, f.episode AS source_episode, frame_idx AS source_frame, round(signal, 6) AS signal, event_type FROM frames f JOIN d ON d.episode = f.episode AND frame_idx BETWEEN start_ AND end_")
def recut_frames(spark, sf):
    return recut(spark, sf)[1].withColumn("signal", F.round("signal", 6))


@query(f"WITH {CUT} SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n WHERE kept) AS kept, (SELECT count(*) FROM n WHERE NOT kept) AS filtered, (SELECT count(*) FROM d) AS segments")
def recut_funnel(spark, sf):
    return recut(spark, sf)[2]


def candidate_pool(spark, sf: str) -> DataFrame:
    """An order's lines as candidates of a scene: verbs and objects by their suppliers and parts."""
    verb = F.element_at(F.array(*map(F.lit, ("place", "put", "move", "open", "turn"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").withColumn("verb", verb)
    tags = F.array(F.concat(F.lit("verb:"), "verb"), F.concat(F.lit("object:"), (F.col("l_partkey") % 5).cast("string")))
    return rows.select(
        F.col("l_orderkey").alias("scene"), F.col("l_linenumber").cast("long").alias("id"), F.concat_ws(" ", "verb", (F.col("l_partkey") % 7).cast("string")).alias("key"),
        tags.alias("tags"), (F.col("l_quantity") % 10).cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("needs_edit"), (F.col("l_linestatus") == "F").alias("reserved"),
    )


CAPS = {"verb:move": 2, "verb:open": 2, "object:0": 2}


@query()
def selected_instructions(spark, sf):
    """Four candidates a scene under caps of verbs and objects, one of them reserved, a third of the rest to be edited."""
    return selection.select_instructions(candidate_pool(spark, sf), 4, 0.3, CAPS)
