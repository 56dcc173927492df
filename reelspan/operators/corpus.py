"""Vocabulary and instruction corpora: counts, balance, percentiles, deduplication, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(phrases: DataFrame, text: str, kinds: list[str]) -> DataFrame:
    """word_type, word and frequency of phrases whose words have one type by place."""
    words = F.split(F.col(text), " ")
    rows = phrases.select(F.explode(F.arrays_zip(F.array(*map(F.lit, kinds)).alias("word_type"), words.alias("word"))).alias("w")).select("w.*")
    return rows.filter("word IS NOT NULL AND word_type IS NOT NULL").groupBy("word_type", "word").agg(F.count("*").alias("frequency"))


def balance(words: DataFrame) -> DataFrame:
    """By word type: words, mean and largest frequency, coefficient of variation (population)."""
    mean = F.avg("frequency")
    return words.groupBy("word_type").agg(
        F.count("*").alias("words"),
        F.round(mean, 6).alias("mean_frequency"),
        F.max("frequency").alias("max_frequency"),
        F.round(F.when(mean > 0, F.stddev_pop("frequency") / mean).otherwise(0.0), 6).alias("cv"),
    )


def label_counts(rows: DataFrame, dimensions: list[str], top: int) -> DataFrame:
    """The `top` most frequent labels of each dimension, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions])).alias("x")).select("x.*")
    counted = long.filter("label IS NOT NULL").groupBy("dimension", "label").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "label")))
    return ranked.filter(F.col("place") <= top)


def lowest(words: DataFrame, n: int) -> DataFrame:
    """The n rarest words of each type, ties by word."""
    w = Window.partitionBy("word_type").orderBy("frequency", "word")
    return words.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def percentile(rows: DataFrame, key: str, value: str, p: float, cuts: int = 256) -> DataFrame:
    """The element floor(n p), at most n - 1, of each key's sorted values; exact.

    Approximate quantiles cut a key's values into ranges, whose counts are cumulated; only the range
    that holds the element is put in order, by counts of its distinct values.
    """
    held = rows.filter(F.col(value).isNotNull()).select(key, value)
    marks = held.groupBy(key).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10 * cuts).alias("_marks"))
    cut = held.join(marks, key).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col(value)))).drop("_marks")
    counted = cut.groupBy(key, "_range", value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    ranges = counted.groupBy(key, "_range").agg(F.sum("_n").alias("_size"))
    upto = ranges.withColumn("_upto", F.sum("_size").over(w.orderBy("_range"))).withColumn("_total", F.sum("_size").over(w))
    place = F.least(F.floor(F.col("_total") * p), F.col("_total") - 1)
    aimed = upto.withColumn("_place", place - (F.col("_upto") - F.col("_size"))).filter((F.col("_place") >= 0) & (F.col("_place") < F.col("_size")))
    inside = counted.join(aimed.select(key, "_range", "_place"), [key, "_range"])
    inside = inside.withColumn("_upto", F.sum("_n").over(w.orderBy(value)))
    return inside.filter((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_n") <= F.col("_place"))).select(key, F.col(value).alias("percentile_value"))


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by `order`, with the number of rows behind it; combines before it shuffles."""
    names = rows.columns
    packed = F.min_by(F.struct(*names), F.col(order))
    return rows.groupBy(key.alias("_key")).agg(packed.alias("_r"), F.count("*").alias("copies")).select("_r.*", "copies")


def greedy_top(rows: DataFrame, group: str, verb: str, score: str, tie: str, cap: int, k: int) -> DataFrame:
    """The k best of each group with at most `cap` of one verb."""
    per_verb = Window.partitionBy(group, verb).orderBy(F.desc(score), tie)
    capped = rows.withColumn("_v", F.row_number().over(per_verb)).filter(F.col("_v") <= cap)
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return capped.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("_v")


def weighted_sample(words: DataFrame, group: str, key: str, usage: str, n: int, power: float, seed: int) -> DataFrame:
    """n words of each group without replacement, weight (usage + 1) ** -power, by seeded exponential keys."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col(key)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    ranked = words.withColumn("_k", -F.log(u) * F.pow(F.col(usage) + 1, power))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_k", key))).filter(F.col("place") <= n).drop("_k")
