"""Benchmark decontamination with DataFrame functions only.

A document is contaminated by an item if some window of it, as long as the item, has a weighted
shingle similarity (Jaccard of multisets of five-word shingles) of at least `threshold` percent.

1. Documents give their shingle hashes with positions; only those that an item has stay (the items'
   shingles are broadcast where their count is under `BROADCAST_ROWS`, joined by shuffle beyond).
2. A window can reach the threshold only if it holds enough of the item's shingles. Moving a window
   on to its next shared shingle never lowers that count, so windows that begin at one are enough.
   What is left is a few windows by leaked passage, each of one item.
3. These windows and the items get 64-bit SimHash fingerprints: per-bit sums over shingles, two
   32-bit counters in each of 32 longs. Fingerprints are cut into `radius + 1` blocks; two that
   differ in at most `radius` bits agree in a block, so joining on (item, block, its bits) finds all.
   A pair is taken at the first block it agrees in, and kept if its distance is within the radius.
   With blocks of so few bits the index alone would hold most windows of a size against most items;
   the item in its key, known since step 1, is what keeps a window from meeting any other.
4. Those pairs are verified on the shingle multisets themselves.

At the threshold of 80 the expected distance is about ten bits; the radius of 23 lies over four
standard deviations beyond it.

Defined results: null or empty texts are never contaminated. Items of fewer than five words are one
shingle, the whole sequence, and found wherever it stands; items without words take no part.
Documents shorter than an item are compared whole. Rows that share a doc_id are judged each and
reported together; items that share an item_id likewise. Words are `[^\\x20\\x09-\\x0D]+` of the
lower-cased text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import store, table, workspace

SHINGLE, THRESHOLD, RADIUS = 5, 80, 23
#: Rows of item shingles (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Longs that hold the counters of a fingerprint's bits, and the bits that one of them takes in a step.
LANES, LANE_MASK = 32, 0x0000000100000001


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of the overlapping runs of `size` words, in order; none for fewer words."""
    run = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, run).otherwise(F.array().cast("array<long>"))


def needed(n: Column, m: Column, threshold: int) -> Column:
    """Shingles that multisets of n and m must share for a similarity of `threshold` percent."""
    return F.ceil(((n + m) * threshold) / F.lit(100.0 + threshold) - 1e-9)


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash by row of `df`, whose array `sh` holds weighted shingles (a shingle's weight is its count)."""
    rows = df.select(*keys, F.explode("sh").alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(LANE_MASK))).alias(f"_{k}") for k in range(LANES)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *sums)

    def bit(k: int, lane: int) -> Column:
        count = F.shiftrightunsigned(f"_{k}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
        value = 1 << (k + 32 * lane)
        return F.when(2 * count > F.col("_n"), F.lit(value - (1 << 64) if value >> 63 else value)).otherwise(F.lit(0)).cast("long")

    bits = reduce(Column.bitwiseOR, [bit(k, lane) for k in range(LANES) for lane in range(2)])
    return counted.select(*keys, bits.alias("fp"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """Start and width of each of radius + 1 runs of the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_rows(df: DataFrame, radius: int) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for i, (a, w) in enumerate(blocks(radius))]
    return df.withColumn("_b", F.explode(F.array(*parts))).select("*", "_b.block", "_b.bits").drop("_b")


def first_agreement(difference: Column, radius: int) -> Column:
    out = F.lit(-1)
    for i, (a, w) in reversed(list(enumerate(blocks(radius)))):
        out = F.when(F.shiftrightunsigned(difference, a).bitwiseAND(F.lit((1 << w) - 1)) == 0, F.lit(i)).otherwise(out)
    return out


def shared_count(x: Column, y: Column) -> Column:
    """Size of the intersection of two multisets."""

    def times(a: Column, v: Column) -> Column:
        return F.size(F.filter(a, lambda u: u == v))

    distinct = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    slow = F.aggregate(F.array_distinct(F.array_intersect(x, y)), F.lit(0), lambda acc, v: acc + F.least(times(x, v), times(y, v)))
    return F.when(distinct, F.size(F.array_intersect(x, y))).otherwise(slow)


def contaminations(docs: DataFrame, items: DataFrame, folder: str, threshold: int = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, start (word) and similarity of each text's best window by item."""
    known = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    runs = F.when(F.col("width") == SHINGLE, shingles(F.col("w"))).otherwise(F.array(F.coalesce(*[F.when(F.col("width") == k, F.xxhash64(*[F.get("w", i) for i in range(k)])) for k in range(1, SHINGLE)])))
    known = known.select("item_id", "width", runs.alias("sh")).withColumn("n", F.size("sh")).withColumn("k", F.xxhash64("item_id", "width", "sh"))
    known = store(known.dropDuplicates(["k"]), folder, "items")
    best = _long_items(docs, known.filter(F.col("width") == SHINGLE), folder, threshold, radius)
    for width in sorted(r["width"] for r in known.select("width").distinct().collect()):  # five rows at most
        if width < SHINGLE:
            marks = _broadcast(known.filter(F.col("width") == width).select("k", F.get("sh", 0).alias("h")))
            texts = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).select("doc_id", "th", shingles(F.col("w"), width).alias("sh"))
            places = texts.select("doc_id", "th", F.posexplode_outer("sh").alias("pos", "h"))
            best = best.unionByName(places.join(marks, "h").groupBy("doc_id", "th", "k").agg(F.min("pos").alias("start")).withColumn("similarity", F.lit(1.0)))
    return best.join(known.select("k", "item_id"), "k").groupBy("doc_id", "th", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("_b")).select("doc_id", "th", "item_id", F.col("_b.start").alias("start"), (-F.col("_b.s")).alias("similarity"))


def _broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _long_items(docs: DataFrame, known: DataFrame, folder: str, threshold: int, radius: int) -> DataFrame:
    """doc_id, th, k, start and similarity of each text's best window by item of at least SHINGLE words."""
    marks = _broadcast(known.select("k", "n", F.explode(F.array_distinct("sh")).alias("h")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).select("doc_id", "th", F.size("w").alias("_words"), shingles(F.col("w")).alias("sh"))
    # the outer form: for the inner one Catalyst infers a filter and would inline the word list into every shingle
    found = texts.select("doc_id", "th", (F.col("_words") - SHINGLE + 1).alias("d"), F.posexplode_outer("sh").alias("pos", "h")).join(marks, "h")
    pairs = found.groupBy("doc_id", "th", "k").agg(F.first("n").alias("n"), F.first("d").alias("d"), F.sort_array(F.collect_set("pos")).alias("a"))
    pairs = pairs.withColumn("m", F.least("n", "d")).withColumn("c", needed(F.col("n"), F.col("m"), threshold).cast("int")).filter(F.size("a") >= F.col("c"))

    def begin(i: Column) -> Column:
        return F.least(F.get("a", i), F.col("d") - F.col("m"))

    enough = F.filter(F.sequence(F.lit(0), F.size("a") - F.col("c")), lambda i: F.get("a", i + F.col("c") - 1) - begin(i) < F.col("m"))
    windows = pairs.select("doc_id", "th", "k", "n", "m", F.explode(F.array_distinct(F.transform(enough, begin))).alias("start"))
    by_text = store(windows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "n", "m", "start")).alias("windows")), folder, "windows")
    whole = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), "text")
    back = whole.join(by_text, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("th"))).select("doc_id", "th", "windows", words(F.col("text")).alias("w"))
    back = back.select("doc_id", "th", "windows", shingles(F.col("w")).alias("sh"))
    cut = back.select("doc_id", "th", "sh", F.explode_outer("windows").alias("_w")).select("doc_id", "th", "_w.*", F.slice("sh", F.col("_w.start") + 1, F.col("_w.m")).alias("sh"))
    keys = ["doc_id", "th", "k", "start"]
    cut = store(cut.dropDuplicates(keys), folder, "cut")
    left = block_rows(fingerprints(cut, keys), radius)
    right = _broadcast(block_rows(fingerprints(known, ["k"]), radius).withColumnRenamed("fp", "item_fp"))
    near = left.join(right, ["k", "block", "bits"]).withColumn("_x", F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.filter((F.bit_count("_x") <= radius) & (first_agreement(F.col("_x"), radius) == F.col("block"))).select(*[F.col(x).alias(f"_{x}") for x in keys])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & (F.col("k") == F.col("_k")) & (F.col("start") == F.col("_start"))
    checked = cut.join(near, same, "left_semi").join(known.select("k", F.col("sh").alias("item_sh")), "k").withColumn("_c", shared_count(F.col("sh"), F.col("item_sh")))
    checked = checked.filter(F.col("_c") * (100 + threshold) >= (F.col("n") + F.col("m")) * threshold)
    checked = checked.withColumn("similarity", F.col("_c") / (F.col("n") + F.col("m") - F.col("_c")))
    best = checked.groupBy("doc_id", "th", "k").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("_b"))
    return best.select("doc_id", "th", "k", F.col("_b.start").alias("start"), (-F.col("_b.s")).alias("similarity"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start (first word of the best window) and similarity of every contamination."""
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), workspace(spark, "op5"))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("_b"))
    return best.select("doc_id", "item_id", F.col("_b.start").cast("long").alias("start"), F.round(-F.col("_b.s"), 6).alias("similarity"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a contamination."""
    found = contaminations(docs, items, workspace(spark, "leaks")).select(F.col("doc_id").alias("_d"), "th").distinct()
    return docs.join(found, F.col("_d").eqNullSafe(docs["doc_id"]) & (found["th"] == F.xxhash64(docs["text"])), "left_anti").select(docs.columns)


def oracle_pairs(documents: str, benchmark: str = "benchmark") -> str:
    """DuckDB common table expressions; the last, `leaks`, has doc_id, item_id, start, similarity."""
    return rf"""
    bw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '') AS w FROM {benchmark}),
    bs AS (SELECT item_id, greatest(len(w) - 4, 1) AS n, least(len(w), 5) AS width,
           list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) AS sh FROM bw WHERE len(w) >= 1),
    dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '') AS w FROM {documents}),
    ds AS (SELECT doc_id, width, len(w) - width + 1 AS d, list_transform(range(len(w) - width + 1), lambda i: array_to_string(w[i + 1 : i + width], ' ')) AS sh
           FROM dw, (SELECT DISTINCT width FROM bs) WHERE len(w) >= width),
    dp AS (SELECT doc_id, width, d, unnest(sh) AS h, generate_subscripts(sh, 1) - 1 AS pos FROM ds),
    bc AS (SELECT item_id, width, n, h, count(*) AS k FROM (SELECT item_id, width, n, unnest(sh) AS h FROM bs) GROUP BY ALL),
    hits AS (SELECT DISTINCT doc_id, width, d, item_id, n, pos FROM dp JOIN bc USING (width, h)),
    starts AS (SELECT DISTINCT doc_id, width, item_id, n, least(n, d) AS m, least(pos, d - least(n, d)) AS start FROM hits),
    inside AS (
      SELECT s.doc_id, s.width, s.item_id, s.n, s.m, s.start, dp.h, count(*) AS times
      FROM starts s JOIN dp ON dp.doc_id = s.doc_id AND dp.width = s.width AND dp.pos >= s.start AND dp.pos < s.start + s.m
      JOIN bc ON bc.item_id = s.item_id AND bc.width = s.width AND bc.h = dp.h GROUP BY ALL),
    scored AS (
      SELECT doc_id, item_id, n, m, start, sum(least(times, k)) AS c
      FROM inside JOIN bc USING (item_id, width, n, h) GROUP BY ALL),
    leaks AS (
      SELECT doc_id, item_id, start, c / (n + m - c) AS similarity,
             row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c / (n + m - c) DESC, start) AS r
      FROM scored WHERE c * 180 >= (n + m) * 80)"""


ORACLE_SQL = f"""WITH {oracle_pairs('documents')}
SELECT doc_id, item_id, start, round(similarity, 6) AS similarity FROM leaks WHERE r = 1
"""
