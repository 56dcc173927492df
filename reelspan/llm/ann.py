"""Approximate nearest neighbours by learned partitions.

A bounded sample (`SAMPLE` distinct vectors at most, taken by hash over all) gives a neighbour graph.
It is cut into parts of equal size, of `OWN` sampled vectors at least, by recursive spectral bisection:
each cut is at the median of the graph's second eigenvector. A small network learns, for each sampled
vector, how its neighbours spread over the parts. It sends every vector of the table to its most
probable part and every query to its most probable ones, where all candidates are ranked by exact
inner products. How many parts a query visits is measured, not set: sampled vectors that the network
was not fitted on must find `TARGET` of their neighbours in the sample.

A part's candidates and queries are dealt into blocks of at most `BLOCK` rows each, so a part that
holds a third of all rows is many tasks; a block returns at most k rows a query. Of equal vectors
only the k + 1 with the smallest vec_id can be among the k nearest of anything; the others leave
before the shuffle, which loses none.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or as candidates. Equal scores go to the smaller
vec_id. Rows that share a vec_id are candidates each, but never for a query of that vec_id; as queries
each of their distinct vectors has a list of its own. A sample too small for two parts is one part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.common import store, table, workspace

#: Vectors of the sample, neighbours of each in the graph, sampled vectors of a part at least, rows of a block.
SAMPLE, DEGREE, OWN, BLOCK = 8192, 24, 64, 4096
#: Share of neighbours to be found by sampled vectors set aside, and how many of those there are at most.
TARGET, ASIDE = 0.94, 512
HIDDEN, STEPS, BATCH, RATE = 128, 600, 512, 2e-3


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the rows with the largest inner products."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        scores = x[at : at + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at : at + 1024] = np.argpartition(-scores, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Parts of equal size, by cutting at the median of the second eigenvector, again and again."""
    n, degree = graph.shape
    a, b = np.repeat(np.arange(n), degree), graph.ravel()
    links = np.unique(np.minimum(a, b) * n + np.maximum(a, b))  # each link once, whichever way it points
    a, b = links // n, links % n
    group, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    count = 1
    while count < parts:
        own = group[a] == group[b]
        x, y = np.append(a[own], b[own]), np.append(b[own], a[own])
        root = np.sqrt(np.bincount(x, minlength=n) + 1.0)
        norm = np.sqrt(np.bincount(group, root * root, count))
        first, v = root / norm[group], rng.normal(size=n)
        for _ in range(60):  # all groups at once: links between them are out
            v = np.bincount(x, v[y] / root[y], n) / root + 0.5 * v
            v -= first * np.bincount(group, first * v, count)[group]
            v /= np.sqrt(np.bincount(group, v * v, count))[group] + 1e-12
        order = np.lexsort((v / root, group))
        sizes = np.bincount(group, minlength=count)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = 2 * group + (place >= sizes[group] // 2)
        count *= 2
    return group


class Router:
    """A network with one hidden layer; its outputs are log-probabilities of parts, up to a constant."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = np.float32(1 / max(np.abs(x).std(), 1e-12))
        sizes = (x.shape[1], HIDDEN, target.shape[1])
        self.p = [rng.normal(size=(a, b)).astype(np.float32) * np.float32(np.sqrt(2 / a)) if s else np.zeros(b, np.float32) for a, b in zip(sizes, sizes[1:], strict=False) for s in (1, 0)]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(x), BATCH)
            b = x[rows] * self.scale
            h = np.maximum(0, b @ self.p[0] + self.p[1])
            z = h @ self.p[2] + self.p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - target[rows]) / BATCH
            back = (d @ self.p[2].T) * (h > 0)
            for i, g in enumerate((b.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x * self.scale) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]


def fit(x: np.ndarray, own: int = OWN, target: float = TARGET) -> tuple[Router | None, int]:
    """The router of a sample and the number of parts that a query visits; None where there is one part."""
    aside = min(ASIDE, len(x) // 8)
    tried, learned = x[:aside], x[aside:]
    parts = 1 << (max(len(learned) // own, 1).bit_length() - 1)
    if parts < 2:
        return None, 1
    graph = neighbour_graph(learned, min(DEGREE, len(learned) - 1))
    part = balanced_parts(graph, parts)
    share = np.zeros((len(learned), parts), np.float32)
    for column in (np.arange(len(learned)), *graph.T):
        share[np.arange(len(learned)), part[column]] += 1
    router = Router(learned, share / share.sum(1, keepdims=True))
    near = np.argsort(-(tried @ learned.T), axis=1)[:, :10]
    held = router.logits(learned).argmax(1)[near]
    rank = np.argsort(np.argsort(-router.logits(tried), axis=1, kind="stable"), axis=1)
    visits = rank[np.arange(aside)[:, None], held]  # how many parts come before the neighbour's
    found = np.cumsum(np.bincount(visits.ravel(), minlength=parts)) / visits.size
    return router, int(np.flatnonzero(found >= target)[0]) + 1


def usable(vector: Column) -> Column:
    limit = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(vector, lambda x: x != 0)


def _best(k: int):
    """The k best candidates of each query in one block, by exact inner products."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "qh": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(candidates):
            return empty
        q = np.array(queries["vector"].to_list(), np.float64)
        candidates = candidates.sort_values("vec_id")
        x, ids = np.array(candidates["vector"].to_list(), np.float64), candidates["vec_id"].to_numpy()
        found = []
        for own, qh, v, row in zip(queries["vec_id"], queries["vh"], q, q @ x.T, strict=True):
            row[ids == own] = -np.inf
            kth = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            at = np.flatnonzero((row >= kth - 1e-9 * (1 + abs(kth))) & (row > -np.inf)) if np.isfinite(kth) else np.flatnonzero(row > -np.inf)
            score = (x[at] * v).sum(1)  # the same order of additions for equal vectors, wherever they stand
            order = np.argsort(-score, kind="stable")[:k]
            found.append(pd.DataFrame({"query_id": own, "qh": qh, "vec_id": ids[at[order]], "score": score[order]}))
        return pd.concat(found, ignore_index=True)

    return run


def search(vectors: DataFrame, is_query: Column, folder: str, k: int = 20, sample: int = SAMPLE, own: int = OWN, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of `vectors` (vec_id, embedding) with `is_query`."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, total = lengths[0]["d"], lengths[0]["count"]
    rows = rows.filter(F.size("vector") == d).withColumn("vh", F.xxhash64("vector"))
    # by the hash of the vector alone, so that equal ones count once
    drawn = rows.select("vector", "vh").filter(F.pmod("vh", F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / total) * (1 << 30)))
    taken = drawn.dropDuplicates(["vh"]).orderBy("vh").limit(sample).collect()
    x = np.array([r["vector"] for r in taken], np.float32).reshape(len(taken), d)
    router, measured = fit(np.random.default_rng(3).permutation(x), own)
    probes = probes or measured
    shared = spark.sparkContext.broadcast(router)

    @F.pandas_udf("array<int>")
    def route(vector: pd.Series, asks: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series([[0]] * len(vector))
        order = np.argsort(-shared.value.logits(np.array(vector.to_list(), np.float32)), axis=1, kind="stable")[:, :probes]
        return pd.Series([o.tolist() if a else [int(o[0])] for o, a in zip(order, asks, strict=True)])

    routed = store(rows.withColumn("parts", route("vector", F.col("asks"))), folder, "routed")
    asks = routed.filter("asks").dropDuplicates(["vec_id", "vh"]).select("vec_id", "vh", "vector", F.explode("parts").alias("part"))
    again = spark.read.schema(routed.schema).parquet(f"{folder}/routed")  # a reading of its own: cogroup needs two
    copy = F.row_number().over(Window.partitionBy("vh", "part").orderBy("vec_id"))
    held = again.select("vec_id", "vh", "vector", F.col("parts")[0].alias("part")).withColumn("_c", copy).filter(F.col("_c") <= k + 1).drop("_c")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))  # a row a part

    sizes = store(blocks(asks, "qs").join(blocks(held, "cs"), "part"), folder, "sizes")
    own, sizes = F.broadcast(spark.read.schema(sizes.schema).parquet(f"{folder}/sizes")), F.broadcast(sizes)
    salt = F.xxhash64("vec_id", "vh")
    asks = asks.join(sizes, "part").withColumn("q", F.pmod(salt, F.col("qs"))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs") - 1)))
    held = held.join(own, "part").withColumn("c", F.pmod(salt, F.col("cs"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    key, cols = ["part", "q", "c"], ["part", "q", "c", "vec_id", "vh", "vector"]
    found = asks.select(cols).groupBy(key).cogroup(held.select(cols).groupBy(key)).applyInPandas(_best(k), "query_id long, qh long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 nearest found for each vec_id divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, workspace(spark, "op7"))
