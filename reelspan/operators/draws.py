"""Seeded draws by md5, so that any engine repeats them: selection, orders, weights, balanced picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.lookup import rank_by


def draw(seed: int, *keys: Column) -> Column:
    """A whole number below 2**32 from the seed and keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def chosen(seed: int, p: float, *keys: Column) -> Column:
    """True with probability p."""
    return draw(seed, *keys) < int(p * (1 << 32))


def weighted_draws(words: DataFrame, group: str, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from each group: a draw falls into the range of its word's cumulated weight."""
    w = Window.partitionBy(group).orderBy(key)
    ranges = words.withColumn("_to", F.sum(weight).over(w)).withColumn("_from", F.col("_to") - F.col(weight))
    totals = ranges.groupBy(group).agg(F.max("_to").alias("_total")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    aimed = totals.withColumn("_at", F.shiftright(draw(seed, F.col(group), F.col("draw")) * F.col("_total"), 32))
    return aimed.join(ranges, group).filter((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select(group, "draw", key)


def balanced_picks(words: DataFrame, group: str, level: str, key: str, each: int, seed: int) -> DataFrame:
    """Up to `each` words of every frequency level of a group, by drawn order."""
    w = Window.partitionBy(group, level).orderBy(draw(seed, F.col(key)), key)
    return words.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)


def epoch_order(rows: DataFrame, dataset: str, key: str, passes: int, seed: int) -> DataFrame:
    """Every row once a pass, in an order drawn for each dataset and pass; ranked inside ranges of the draw."""
    many = rows.withColumn("epoch_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    many = many.withColumn("_group", F.struct(dataset, "epoch_pass")).withColumn("_at", draw(seed, F.col("epoch_pass"), F.col(key)))
    return rank_by(many, "_group", "_at", key, "place").drop("_group", "_at")
