"""Joins of samples, videos and annotations; interleaved datasets; padded batches; counters of a funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: So many stems are broadcast; more are merged with the names' parts. Those are never broadcast: Spark guesses their size from a few names' columns.
FEW_STEMS = 100_000


def annotation_of(videos: DataFrame, annotations: DataFrame, few: int = FEW_STEMS) -> DataFrame:
    """stem and the annotation name that belongs to it, null without one.

    That is the first name of the form *_<stem>_ep_*, else the first *_ep_* that contains the stem. Both
    are joins on equal strings: a name is looked up by its parts between a `_` and an `_ep_`, and, for
    stems still without a match, by its substrings of the lengths such stems have.
    """
    stems = videos.select("stem").distinct()
    is_few = stems.limit(few + 1).count() <= few

    def near(own: DataFrame, parts: DataFrame) -> DataFrame:
        return F.broadcast(own).join(parts, "stem") if is_few else own.join(parts.hint("merge"), "stem")

    names = annotations.select("name").distinct()
    starts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)) == "_")
    ends = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(4)) == "_ep_")
    # a name without characters has none of them
    cut = names.filter(F.length("name") > 0).withColumn("_e", ends).filter(F.size("_e") > 0).withColumn("_s", starts)
    spans = cut.select("name", F.explode("_s").alias("_s"), "_e").select("name", "_s", F.explode("_e").alias("_e")).filter("_e > _s")
    parts = spans.select("name", F.substring("name", F.col("_s") + 1, F.col("_e") - F.col("_s") - 1).alias("stem"))
    exact = near(stems, parts).groupBy("stem").agg(F.min("name").alias("name"))
    rest = stems.join(exact, "stem", "left_anti")
    lengths = rest.select(F.length("stem").alias("_n")).filter("_n > 0").distinct()
    long = cut.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("_n")).join(lengths, "_n")
    held = long.select("name", "_n", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("_n") + 1)).alias("_i"))
    loose = near(rest, held.select("name", F.substring("name", F.col("_i"), F.col("_n")).alias("stem"))).groupBy("stem").agg(F.min("name").alias("name"))
    found = exact.unionByName(loose)
    return videos.join(F.broadcast(found) if is_few else found.hint("merge"), "stem", "left")


def samples(index: DataFrame, episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Index rows (sample, episode, frame_idx) with their episode's and frame's columns; missing ones stay null."""
    return index.join(frames, ["episode", "frame_idx"], "left").join(episodes, "episode", "left")


def rank_by(rows: DataFrame, group: str, drawn: str, tie: str, name: str, bits: int = 12) -> DataFrame:
    """The place (from 0) of each row of a group by (drawn, tie), where `drawn` is below 2**32.

    Rows are only ordered inside 2**bits ranges of `drawn`, whose counts are cumulated: no task holds a group.
    """
    cut = rows.withColumn("_b", F.shiftright(drawn, 32 - bits))
    counts = cut.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(drawn, tie)) - 1
    return cut.withColumn("_r", inside).join(base, [group, "_b"]).withColumn(name, F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def interleaved(items: DataFrame, dataset: str, place: str, slot_draw: Column) -> DataFrame:
    """All datasets in one drawn order that keeps each one's own: items (place from 0, dense) take their dataset's slots in turn.

    `slot_draw`, below 2**32, is over dataset and place; `at` is the value to order by, ties by dataset and place.
    """
    slots = rank_by(items.select(dataset, F.col(place).alias("_p"), slot_draw.alias("at")), dataset, "at", "_p", "_slot")
    return items.join(slots.select(dataset, F.col("_slot").alias(place), "at"), [dataset, place])


def padded_tokens(rows: DataFrame, batch: str, ids: str, pad: int, side: str = "right", most: int | None = None) -> DataFrame:
    """ids of a batch at one width (at most `most`, cut at the end) and their mask: 1 for a token, 0 for padding.

    Padding is told by place, so a token with the id of the padding keeps its 1.
    """
    cut = rows.withColumn(ids, F.slice(ids, 1, most)) if most else rows
    widths = cut.groupBy(batch).agg(F.max(F.size(ids)).alias("_w"))
    wide = cut.join(widths, batch)
    gap = F.col("_w") - F.size(ids)
    fill, ones, none = F.array_repeat(F.lit(pad).cast("long"), gap), F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)
    own = F.col(ids).cast("array<long>")
    both = (F.concat(fill, own), F.concat(none, ones)) if side == "left" else (F.concat(own, fill), F.concat(ones, none))
    return wide.withColumns({"padded": both[0], "mask": both[1]}).drop("_w")


def funnel(rows: DataFrame, root: str, kept: Column, segments: Column) -> DataFrame:
    """By root: rows, kept, filtered out, and segments of those kept."""
    keep = F.coalesce(kept, F.lit(False))
    out = rows.groupBy(root).agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.coalesce(F.sum(F.when(keep, segments)), F.lit(0)).cast("long").alias("segments"))
    return out.withColumn("filtered", F.col("total") - F.col("kept"))
