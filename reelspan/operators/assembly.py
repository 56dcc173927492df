"""Instructions assembled from templates and slot words in rounds, with a cap on each object's use across the whole batch.

A round draws more candidates than are wanted, all from (round, number): a template, and for each of its
slots a word by the weight of its use so far. Of these stay the ones without a repeated object, not known yet, the
first of equal ones, and those whose objects are all among their words' first candidates under the cap, in
order of number, until the count is met. The cap counts every candidate before, also those that another word's cap then
drops, so it is never exceeded; what a round leaves open the next one draws again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.draws import draw
from reelspan.operators.lookup import rank_by
from reelspan.operators.vocabulary import fill
from reelspan.sources.folders import scratch

#: Weight of an unused word; ranges of a slot's words in which a draw looks; candidates for each instruction wanted.
WHOLE, RANGES, OVER = 1_000_000, 256, 3


def normal(instruction: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(instruction, r"\s+", " ")))


def weighted_ranges(words: DataFrame) -> DataFrame:
    """A row a slot: total weight and, by range of word hashes, the words with their cumulated weights. `words` has slot, word, used."""
    weight = F.floor(F.lit(WHOLE) / (F.col("used") + 1))
    cut = words.withColumn("_w", weight).withColumn("_b", F.conv(F.substring(F.md5("word"), 1, 2), 16, 10).cast("int"))
    own = Window.partitionBy("slot", "_b").orderBy("word")
    cut = cut.withColumn("_to", F.sum("_w").over(own))
    packed = cut.groupBy("slot", "_b").agg(F.sort_array(F.collect_list(F.struct(F.col("_to").alias("to"), "word"))).alias("words"), F.sum("_w").alias("_sum"))
    base = F.sum("_sum").over(Window.partitionBy("slot").orderBy("_b"))  # RANGES rows a slot
    return packed.withColumn("upto", base).withColumn("start", F.col("upto") - F.col("_sum")).select("slot", "_b", "words", "start", "upto")


def picked(asked: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """`asked` (round, n, slot) with the word that each draw falls on; slots without words give none."""
    ranges = weighted_ranges(words)
    slots = ranges.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("upto", "_b"))).alias("_s"), F.max("upto").alias("_total"))
    at = F.floor(draw(seed, F.col("round"), F.col("n"), F.col("slot")) / float(1 << 32) * F.col("_total"))
    aimed = asked.join(slots, "slot").withColumn("_at", at)
    aimed = aimed.withColumn("_b", F.filter("_s", lambda s: s["upto"] > F.col("_at"))[0]["_b"]).drop("_s", "_total")
    found = aimed.join(ranges, ["slot", "_b"])
    word = F.filter("words", lambda w: w["to"] > F.col("_at") - F.col("start"))[0]["word"]
    return found.select(*asked.columns, word.alias("word"))


def candidates(templates: DataFrame, words: DataFrame, number: int, count: int, seed: int, skip: float) -> DataFrame:
    """round, n, template_id, instruction and objects of `count` drawn candidates; those that lack a word for a slot are left out.

    `templates` has place (from 0), template_id, pattern and slots (name, kind: object or quality); `words` slot, word, used.
    """
    spark = templates.sparkSession
    total = templates.count()
    drawn = spark.range(count).select(F.lit(number).alias("round"), F.col("id").alias("n"))
    place = F.shiftright(draw(seed, F.lit("template"), F.col("round"), F.col("n")) * total, 32)
    rows = drawn.withColumn("place", place).join(F.broadcast(templates), "place")  # hand-written templates
    slots = rows.select("round", "n", F.explode("slots").alias("s")).select("round", "n", F.col("s.name").alias("slot"), F.col("s.kind").alias("kind"))
    left_out = (F.col("kind") == "quality") & (draw(seed, F.lit("skip"), F.col("round"), F.col("n"), F.col("slot")) < int(skip * (1 << 32)))
    named = picked(slots.filter(~left_out), words, seed).unionByName(slots.filter(left_out).withColumn("word", F.lit("")))
    entry = F.struct("slot", "word")
    held = named.groupBy("round", "n").agg(F.collect_list(entry).alias("_e"), F.collect_list(F.when(F.col("kind") == "object", F.lower(F.trim("word")))).alias("objects"))
    whole = rows.join(held, ["round", "n"]).filter(F.size("_e") == F.size("slots"))
    return whole.select("round", "n", "template_id", fill(F.col("pattern"), F.map_from_entries("_e")).alias("instruction"), "objects", F.col("_e").alias("words"))


def accepted(rows: DataFrame, known: DataFrame, used: DataFrame, cap: int, wanted: int, count: int) -> DataFrame:
    """The candidates of a round that count: at most `wanted`, none known, no object over `cap` with its use so far (word, used)."""
    fresh = rows.filter(F.size("objects") == F.size(F.array_distinct("objects"))).withColumn("_k", normal(F.col("instruction")))
    fresh = fresh.groupBy("_k").agg(F.min_by(F.struct(*rows.columns), "n").alias("_r")).select("_k", "_r.*")
    fresh = fresh.join(known.select("_k"), "_k", "left_anti")
    each = fresh.select("n", F.explode("objects").alias("word"))
    # of a word only its first `cap` candidates can count, so a word in most of them is cut before it is ordered
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("n"))).filter(F.col("_r") <= cap)
    inside = ranked.join(used, "word", "left").filter(F.col("_r") + F.coalesce("used", F.lit(0)) <= cap)
    allowed = inside.groupBy("n").agg(F.count("*").alias("_ok"))
    whole = fresh.join(allowed, "n", "left").filter(F.coalesce("_ok", F.lit(0)) == F.size("objects")).drop("_ok")
    scaled = whole.withColumn("_g", F.lit(0)).withColumn("_at", F.shiftleft("n", 32) / count)
    return rank_by(scaled.withColumn("_at", F.floor("_at")), "_g", "_at", "n", "_place").filter(F.col("_place") < wanted).drop("_g", "_at", "_place")


def assembled(templates: DataFrame, words: DataFrame, known: DataFrame, wanted: int, cap: int, seed: int, rounds: int = 5, skip: float = 0.25) -> DataFrame:
    """round, n, template_id, instruction and objects of up to `wanted` instructions; fewer where `rounds` or the caps don't allow more.

    `words` has slot, word and used; `known` instruction. Each round's choice is a table, so its draws are made once.
    """
    spark, folder = templates.sparkSession, scratch(templates.sparkSession, f"assembly-{uuid.uuid4().hex}")
    known = known.select(normal(F.col("instruction")).alias("_k"))
    none = spark.createDataFrame([], "word string, used long")
    chosen, need = None, wanted
    for number in range(rounds):
        count = need * OVER
        if chosen is None:
            use, uses = none, words
        else:
            own = chosen.select(F.explode("words").alias("w")).groupBy(F.col("w.slot").alias("slot"), F.col("w.word").alias("word")).agg(F.count("*").alias("_u"))
            uses = words.join(own, ["slot", "word"], "left").withColumn("used", F.col("used") + F.coalesce("_u", F.lit(0))).drop("_u")
            use = chosen.select(F.explode("objects").alias("word")).groupBy("word").agg(F.count("*").alias("used"))
        rows = candidates(templates, uses, number, count, seed, skip)
        accepted(rows, known, use, cap, need, count).write.parquet(f"{folder}/{number}")
        new = spark.read.parquet(f"{folder}/{number}")
        chosen = new if chosen is None else chosen.unionByName(new)
        known = known.unionByName(new.select("_k"))
        need -= new.count()
        if need <= 0:
            break
    return chosen.select("round", "n", "template_id", "instruction", "objects")
