"""Hard negatives by threshold joins over an inverted index whose lists leave out what norms cover.

A join takes anchors with a threshold each, and finds every row with at least that inner product.
Rows are dealt evenly into blocks, and each block of anchors meets each block of rows in one task.
There components stand in ascending order of their weight. The first components of a row are left out of the index as long as
their norm stays below every anchor's threshold over its norm: alone they can't reach it.
The others stand in lists of `PANEL` components. Partial scores are accumulated from the heaviest list
down; after each list a pair goes whose partial score, plus the product of the norms of what is still to come,
lies below the anchor's threshold, and a row without pairs leaves the lists. What survives is scored
exactly, in integers, omitted components included.

Thresholds start high and are lowered for those anchors whose windows didn't fill: positives at
`POSITIVE` of the product of the norms, negatives at `NEGATIVE` of their band counted from its upper
end. The last threshold is the least that counts, so nothing is missed. A task returns at most k rows a
window, and the best k of all rows are among them.

Defined results: rows without vec_id, label or vector, with null or non-finite components or with
components beyond 2^27 as integers (their scores wouldn't fit into a long) take no part. Vectors of
different lengths have no score. Rows that share a vec_id are candidates each, but never positives of
an anchor of that vec_id; each of its distinct (label, vector) is an anchor. A positive with a
score below 0 has an empty band; one of 0 has the negatives of score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.common import store, table, workspace
from reelspan.llm.integer_vectors import countable, integers

#: Anchors and rows of a block at most, anchors taken together in a task, components of a list.
ANCHORS, BLOCK, TOGETHER, PANEL = 4096, 32768, 128, 8
#: Thresholds in turn; after the last of POSITIVE everything counts.
POSITIVE, NEGATIVE = (0.5, 0.25), (1 / 64, 1 / 8, 1.0)
LEAST, MOST = -(1 << 62), 1 << 62
WINDOWS = "array<struct<w:int,low:long,high:long>>"


class NormIndex:
    """Lists of components of rows, without the first ones whose norm is below `least`, the least threshold for anchors of norm 1."""

    def __init__(self, rows: np.ndarray, least: float):
        self.order = np.argsort((rows * rows).sum(0), kind="stable")
        x = rows[:, self.order]
        self.before = np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, 1)], 1))  # norms of the first components
        covered = self.before < least * (1 - 1e-9) if least > 0 else np.zeros(self.before.shape, bool)
        self.first = np.maximum(covered.sum(1) - 1, 0)  # norms grow, so the covered ones come first
        self.panels = []
        for at in range((x.shape[1] - 1) // PANEL * PANEL, -1, -PANEL):
            ids = np.flatnonzero(self.first < min(at + PANEL, x.shape[1]))
            values = np.where(np.arange(at, min(at + PANEL, x.shape[1])) >= self.first[ids, None], x[ids, at : at + PANEL], 0)
            self.panels.append((at, ids, values))

    def reaching(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs (anchor, row) that may reach the anchor's threshold, and the products that were added for them."""
        q = anchors[:, self.order]
        before = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(q * q, 1)], 1))
        least = least - 1e-9 * (1 + np.abs(least))
        partial = np.zeros((len(q), len(self.first)))
        alive, open_, added = np.ones(partial.shape, bool), np.ones(len(self.first), bool), 0
        for at, ids, values in self.panels:
            own = open_[ids]
            ids, values = ids[own], values[own]
            partial[:, ids] += q[:, at : at + PANEL] @ values.T
            added += len(q) * values.size
            if len(ids):
                rest = np.maximum(at, self.first[ids])  # components before this aren't added yet
                bound = before[:, rest] * self.before[ids, rest]
                alive[:, ids] &= partial[:, ids] + bound * (1 + 1e-9) >= least[:, None]
                open_[ids] = alive[:, ids].any(0)
        never = np.flatnonzero(self.first >= q.shape[1])  # rows without any list
        alive[:, never] &= before[:, -1:] * self.before[never, -1] >= least[:, None]
        return *np.nonzero(alive), added


def _meet(k: int, same: bool):
    """Of one block of anchors and one of rows: the first k rows of each window."""
    schema = pa.schema([("a", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = t["v"].combine_chunks()
        offsets = v.offsets.to_numpy().astype(np.int64)
        return offsets[:-1], np.diff(offsets), v.values.to_numpy().astype(np.int64)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        (a_at, a_size, a_flat), (r_at, r_size, r_flat) = arrays(anchors), arrays(rows)
        windows = anchors["windows"].to_pylist()
        floors = np.array([min((w["low"] for w in x), default=MOST) for x in windows], np.float64)
        a_id, a_vec, a_label = (anchors[c].to_numpy() for c in ("a", "vec_id", "label"))
        r_vec, r_label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for size in np.unique(a_size):
            mine, theirs = np.flatnonzero(a_size == size), np.flatnonzero(r_size == size)
            if not len(theirs):
                continue
            q, x = (flat[at[own][:, None] + np.arange(size)] for flat, at, own in ((a_flat, a_at, mine), (r_flat, r_at, theirs)))
            norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            index = NormIndex(x.astype(np.float64), (floors[mine] / np.maximum(norms, 1)).min()) if size else None
            for some in range(0, len(mine), TOGETHER):
                part = np.arange(some, min(some + TOGETHER, len(mine)))
                i, j = index.reaching(q[part].astype(np.float64), floors[mine[part]])[:2] if size else np.nonzero(np.ones((len(part), len(theirs)), bool))
                own, other = mine[part[i]], theirs[j]
                equal = a_label[own] == r_label[other]
                wanted = equal & (a_vec[own] != r_vec[other]) if same else ~equal
                i, j, own, other = (y[wanted] for y in (i, j, own, other))
                score = np.concatenate([(q[part[i[at : at + 65536]]] * x[j[at : at + 65536]]).sum(1) for at in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
                order = np.lexsort((r_vec[other], -score, own))
                own, other, score = own[order], other[order], score[order]
                ends = np.searchsorted(own, mine[part], side="right")
                starts = np.searchsorted(own, mine[part], side="left")
                for anchor, start, end in zip(mine[part], starts, ends, strict=True):
                    falling = -score[start:end]
                    for w in windows[anchor]:
                        lo, hi = np.searchsorted(falling, -w["high"], side="left"), np.searchsorted(falling, -w["low"], side="right")
                        at = np.arange(start + lo, start + min(hi, lo + k))
                        out.append((np.full(len(at), a_id[anchor]), np.full(len(at), w["w"], np.int32), r_vec[other[at]], score[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def band_join(anchors: DataFrame, rows: DataFrame, total: tuple[int, int], k: int, same: bool) -> DataFrame:
    """a, w, rank, vec_id, score: the first k rows (vec_id, label, v, row) inside each window of each of `anchors` (the same, with a and windows)."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    qs, cs = -(-total[0] // ANCHORS), max(-(-total[1] // BLOCK), min(tasks, -(-total[1] // 256)))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.select((F.col("a") % qs).cast("int").alias("q"), numbers(cs).alias("c"), "a", "vec_id", "label", "v", "windows")
    right = rows.select(numbers(qs).alias("q"), F.pmod(F.xxhash64("row"), F.lit(cs)).cast("int").alias("c"), "vec_id", "label", "v")
    met = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_meet(k, same), "a long, w int, vec_id long, score long")
    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _filled(anchors: DataFrame, rows: DataFrame, total: tuple[int, int], k: int, same: bool, steps: list, folder: str, name: str) -> DataFrame:
    """Joins with falling thresholds until all windows hold k rows or have reached their last; `steps` are the lows by w, as functions of a window."""
    def raised(low) -> Column:
        return F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], low(w)).alias("low"), w["high"].alias("high")))

    def unfilled(low) -> Column:  # windows whose threshold is already their last are whole as well
        return F.filter("windows", lambda w: ~F.array_contains("_full", w["w"]) & (low(w) > w["low"]))

    done, waiting = None, anchors
    for n, low in enumerate(steps):
        asked = waiting.withColumn("windows", raised(low))
        found = store(band_join(asked, rows, total, k, same), folder, f"{name}-{n}")
        if n + 1 == len(steps):
            whole = found
        else:
            full = found.filter(F.col("rank") == k).groupBy("a").agg(F.collect_set("w").alias("_full"))
            marked = waiting.join(full, "a", "left").withColumn("_full", F.coalesce("_full", F.array().cast("array<int>")))
            waiting = store(marked.withColumn("windows", unfilled(low)).filter(F.size("windows") > 0).drop("_full"), folder, f"{name}-left-{n}")
            again = waiting.select("a", F.explode("windows.w").alias("w"))
            whole = found.join(again, ["a", "w"], "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if n + 1 < len(steps):
            left = waiting.count()
            if not left:
                break
            total = (left, total[1])
    return done


def hard_negatives(vectors: DataFrame, is_anchor: Column, folder: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among `vectors` (vec_id, label, v of integers).

    Positives are an anchor's best rows of its label; negatives of each the best rows of other labels with
    low to high hundredths of its score.
    """
    spark = vectors.sparkSession
    rows = store(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v", is_anchor.alias("asks"), F.monotonically_increasing_id().alias("row")), folder, "rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    asks = rows.filter("asks").groupBy("vec_id", "label", "v").agg(F.min("row").alias("row"))
    asks = store(asks.select("vec_id", "label", "v", F.xxhash64("row").bitwiseAND(F.lit((1 << 62) - 1)).alias("a"), norm.alias("norm")), folder, "anchors")
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    total = (asks.count(), size["n"])
    if not total[0]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.select("vec_id", "label", "v", "row")

    every = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))).cast(WINDOWS)
    lows = [lambda w, f=f: F.floor(F.col("norm") * (f * size["norm"])) for f in POSITIVE] + [lambda w: w["low"]]
    near = _filled(asks.withColumn("windows", every), rows, total, positives, True, lows, folder, "positives")
    near = store(near.select("a", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), folder, "positives")

    least = F.expr(f"(positive_score * {low} + 99) div 100")
    most = F.expr(f"(positive_score * {high}) div 100")
    bands = near.filter("positive_score >= 0").groupBy("a").agg(F.collect_list(F.struct(F.col("p").alias("w"), least.alias("low"), most.alias("high"))).cast(WINDOWS).alias("windows"))
    asked = store(asks.join(bands, "a"), folder, "bands")
    lows = [lambda w, f=f: w["high"] - F.ceil((w["high"] - w["low"]) * f) for f in NEGATIVE]
    count = asked.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    hard = _filled(asked, rows, (count, total[1]), negatives, False, lows, folder, "negatives")
    named = near.join(asks.select("a", F.col("vec_id").alias("anchor_id")), "a").withColumnRenamed("p", "w")
    return hard.join(named, ["a", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors with vec_id divisible by 100."""
    known = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & countable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = known.select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, workspace(spark, "op11"))


ORACLE_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10
"""
