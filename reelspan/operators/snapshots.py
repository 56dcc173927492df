"""Corpus state kept as snapshots: counters merged batch by batch, seeds, caps, and what is known already."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.sources.folders import scratch


def merged(snapshot: DataFrame, batch: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The snapshot with the batch's counts added; keys that are new start from zero."""
    added = batch.groupBy(*keys).agg(F.sum(count).alias("_add"))
    both = snapshot.select(*keys, count).join(added, keys, "full_outer")
    return both.select(*keys, (F.coalesce(count, F.lit(0)) + F.coalesce("_add", F.lit(0))).cast("long").alias(count))


def known(rows: DataFrame, snapshot: DataFrame, key: str, normal: Callable[[Column], Column], new: bool = False) -> DataFrame:
    """Rows whose key is in the snapshot in its normal form (`new`: those whose key isn't)."""
    held = snapshot.select(normal(F.col(key)).alias("_k")).distinct()
    return rows.withColumn("_k", normal(F.col(key))).join(held, "_k", "left_anti" if new else "left_semi").drop("_k")


def usage(words: DataFrame, kinds: str, count: str) -> DataFrame:
    """Words, least and largest count of each kind."""
    return words.groupBy(kinds).agg(F.count("*").alias("words"), F.min(count).alias("least"), F.max(count).alias("most"))


def at_cap(use: DataFrame, caps: DataFrame, kinds: str, uncapped: list[str]) -> DataFrame:
    """Kinds whose largest count has reached their cap (a row a kind: kind, cap); kinds in `uncapped` never have."""
    return use.join(caps, kinds).filter((F.col("most") >= F.col("cap")) & ~F.col(kinds).isin(uncapped))


def short_of(slots: DataFrame, use: DataFrame, kinds: str, least: int, slack: int = 0) -> DataFrame:
    """Slots (a row a kind) with fewer words than least - slack, those without any word included."""
    return slots.join(use, kinds, "left").withColumn("words", F.coalesce("words", F.lit(0))).filter(F.col("words") < least - slack)


def should_expand(slots: DataFrame, use: DataFrame, caps: DataFrame, kinds: str, least_use: int, uncapped: list[str]) -> DataFrame:
    """One row: does a slot lack words, has a capped one reached its cap, or is every least count at `least_use`?"""
    rows = slots.join(use, kinds, "left").join(caps, kinds, "left")
    full = F.coalesce((F.col("most") >= F.col("cap")) & ~F.col(kinds).isin(uncapped), F.lit(False))
    empty = F.col("least").isNull()
    worn = F.coalesce(F.col("least") >= least_use, F.lit(False))
    return rows.agg(F.coalesce(F.bool_or(empty) | F.bool_or(full) | F.bool_and(worn), F.lit(False)).alias("expand"))


def seeded(snapshot: DataFrame, seeds: DataFrame, kinds: str, word: str, count: str, least: int) -> DataFrame:
    """The snapshot with seeds (kinds, word, place) that are new, in order of place, until a kind has `least` words; they start at zero."""
    have = snapshot.groupBy(kinds).agg(F.count("*").alias("_have"))
    fresh = seeds.join(snapshot.select(kinds, word), [kinds, word], "left_anti").groupBy(kinds, word).agg(F.min("place").alias("place"))
    # seeds are a hand-written list, a few hundred a kind
    ranked = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(kinds).orderBy("place", word)))
    wanted = ranked.join(have, kinds, "left").filter(F.col("_r") <= least - F.coalesce("_have", F.lit(0)))
    return snapshot.select(kinds, word, count).unionByName(wanted.select(kinds, word, F.lit(0).cast("long").alias(count)))


def vocabulary_growth(old: DataFrame, new: DataFrame, word: str) -> DataFrame:
    """Words of either side with where they come from: old, new or both."""
    both = old.select(word).distinct().withColumn("_o", F.lit(True)).join(new.select(word).distinct().withColumn("_n", F.lit(True)), word, "full_outer")
    return both.select(word, F.when(F.col("_n").isNull(), "old").when(F.col("_o").isNull(), "new").otherwise("both").alias("origin"))


class Versions:
    """Versions of a snapshot in a shared folder, one a micro-batch: a replayed batch writes its own version again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch(spark, f"snapshot-{uuid.uuid4().hex}")

    def read(self, number: int, schema: str) -> DataFrame:
        """The version of a batch; empty for batches that never were."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/v={number}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={number}")


def counting(versions: Versions, keys: list[str], schema: str, count: str = "frequency") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's rows by key to the last version and writes the next one."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(*keys).agg(F.count("*").alias(count))
        versions.write(merged(versions.read(number - 1, schema), rows, keys, count), number)

    return run
