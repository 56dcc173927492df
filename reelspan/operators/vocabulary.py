"""Near-duplicate words by blocking, ordered acceptance, and templates filled from slots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.sources.folders import scratch

SPREAD, DIFFERENCES, PREFIX = 2, 2, 4


def is_near(a: Column, b: Column) -> Column:
    """The same first four letters (both longer), or lengths within two and at most two places that differ."""
    short = F.least(F.length(a), F.length(b))
    differing = F.size(F.filter(F.sequence(F.lit(1), short), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    close = (F.abs(F.length(a) - F.length(b)) <= SPREAD) & (F.when(short > 0, differing).otherwise(0) <= DIFFERENCES)
    stem = (F.length(a) > PREFIX) & (F.length(b) > PREFIX) & (F.left(a, F.lit(PREFIX)) == F.left(b, F.lit(PREFIX)))
    return stem | close


def _blocks(word: Column) -> Column:
    """Keys of which near words share one: the stem, and for each pair of lengths three runs of places.

    Of three runs that cover the shorter word, two differing places leave one run equal.
    """
    keys = [F.when(F.length(word) > PREFIX, F.concat(F.lit("p:"), F.left(word, F.lit(PREFIX))))]
    for other in range(-SPREAD, SPREAD + 1):
        size = F.length(word)
        short, long = F.least(size, size + other), F.greatest(size, size + other)
        for i in range(DIFFERENCES + 1):
            start, stop = F.floor(short * i / (DIFFERENCES + 1)), F.floor(short * (i + 1) / (DIFFERENCES + 1))
            part = F.substr(word, (start + 1).cast("int"), (stop - start).cast("int"))
            keys.append(F.when(short >= 0, F.concat_ws(":", short.cast("string"), long.cast("string"), F.lit(str(i)), part)))
    return F.array_compact(F.array(*keys))


def near_pairs(words: DataFrame, word: str) -> DataFrame:
    """Distinct pairs a < b of near words."""
    rows = words.select(F.col(word).alias("a")).filter("a IS NOT NULL").distinct().select("a", F.explode(_blocks(F.col("a"))).alias("_k"))
    pairs = rows.join(rows.select(F.col("a").alias("b"), "_k"), "_k").filter("a < b").select("a", "b").distinct()
    return pairs.filter(is_near(F.col("a"), F.col("b")))


def accepted(words: DataFrame, word: str) -> DataFrame:
    """Words taken in their order, each unless an earlier taken word is near; settled in rounds.

    A round takes the words without an undecided earlier neighbour and drops what is near them.
    """
    spark = words.sparkSession
    folder = scratch(spark, f"accepted-{uuid.uuid4().hex}")
    pairs = near_pairs(words, word)
    pairs.write.mode("overwrite").parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    state = words.select(F.col(word).alias("w")).filter("w IS NOT NULL").distinct().withColumn("kept", F.lit(None).cast("boolean"))
    step = 0
    while True:
        state.write.mode("overwrite").parquet(f"{folder}/{step}")
        state, step = spark.read.parquet(f"{folder}/{step}"), step + 1
        if not state.filter("kept IS NULL").limit(1).count():
            return state.filter("kept").select(F.col("w").alias(word))
        undecided = state.filter("kept IS NULL").select("w")
        waits = pairs.join(undecided.withColumnRenamed("w", "a"), "a").select(F.col("b").alias("w")).distinct()
        taken = undecided.join(waits, "w", "left_anti").withColumn("_taken", F.lit(True))
        gone = pairs.join(taken.select(F.col("w").alias("a")), "a").select(F.col("b").alias("w")).distinct().withColumn("_gone", F.lit(True))
        state = state.join(taken, "w", "left").join(gone, "w", "left")
        state = state.select("w", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("_taken"), True).when(F.col("_gone"), False).alias("kept"))


def fill(template: Column, slots: Column) -> Column:
    """{slot} marks replaced from a map; marks without a word go, and so does doubled white space."""
    put = F.aggregate(F.map_entries(slots), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(put, r"\{[^{}]*\}", ""), r"\s+", " "))
