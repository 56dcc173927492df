"""Clustering by centroids that are searched through a vantage-point tree.

Each round the driver builds a tree over the centroids (k rows of d integers, whatever the table's
size) and broadcasts it; each vector searches it best first: of the nodes that it has yet to see it
opens the one with the smallest lower bound, and it stops when that bound lies beyond the distance of
its nearest centroid so far. Bounds come from distances to vantage points by the triangle inequality,
with a margin over the rounding of their square roots; a bound equal to the radius is still opened, so
equal distances are all seen and the smaller number wins. Distances are integer sums. All vectors of a batch take
their own next step together, so the steps are numpy's.

A round is one pass over the integer vectors (a table of the workspace): tasks return a count and
a sum vector a cluster, which are added as decimals, and the driver gets k rows of them.

Defined results: vectors that are null, of another length, or hold null or non-finite components or
components beyond 2^27 as integers (their distances wouldn't fit into a long) take no part, nor do rows
without vec_id. Of rows with the same vec_id each is a vector. With fewer vectors than k each starts a
cluster; without vectors the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import store, table, workspace
from reelspan.llm.integer_vectors import countable, integers

K, ROUNDS, SIZE, LEAF = 40, 5, 64, 3
FAR = np.iinfo(np.int64).max


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of `x` to each row of `y`."""
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)


class VantageTree:
    """Nodes in lists: an inner node has a vantage centroid and two children, each with the least and greatest distance of its
    centroids to that vantage; a leaf has up to `LEAF` centroids."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.leaf = centroids, leaf
        self.members: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self._grow(np.arange(len(centroids)))

    def _grow(self, members: np.ndarray) -> int:
        own = len(self.members)
        self.members.append(members)
        self.children.append([])
        if len(members) <= self.leaf:
            return own
        among = squared(self.centroids[members], self.centroids[members])
        vantage = int(among.astype(np.float64).sum(1).argmax())  # the outermost: it tells the others apart best
        others = np.delete(np.arange(len(members)), vantage)
        others = others[np.argsort(among[vantage, others], kind="stable")]
        self.members[own] = members[[vantage]]
        for half in np.array_split(others, 2):
            if len(half):
                reach = np.sqrt(among[vantage, half[[0, -1]]].astype(np.float64))
                self.children[own].append((self._grow(np.sort(members[half])), reach[0], reach[1]))
        return own

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the number of its nearest centroid and the squared distance; and how many distances were taken."""
        n, taken = len(x), 0
        best, cluster = np.full(n, FAR), np.zeros(n, np.int64)
        bounds = np.full((n, len(self.members)), np.inf)
        bounds[:, 0] = 0
        rows = np.arange(n)
        while len(rows):
            node = bounds[rows].argmin(1)
            bound = bounds[rows, node]
            open_ = bound <= np.sqrt(best[rows].astype(np.float64))
            rows, node, bound = rows[open_], node[open_], bound[open_]
            for at in np.unique(node):
                own, least = rows[node == at], bound[node == at]
                found = squared(x[own], self.centroids[self.members[at]])
                taken += found.size
                for distance, number in zip(found.T, self.members[at], strict=True):
                    better = (distance < best[own]) | (distance == best[own]) & (number < cluster[own])
                    best[own[better]], cluster[own[better]] = distance[better], number
                reach = np.sqrt(found[:, 0].astype(np.float64))
                for child, low, high in self.children[at]:
                    margin = 1e-9 * (reach + high + 1)
                    bounds[own, child] = np.maximum(least, np.maximum(low - reach, reach - high) - margin)
                bounds[own, at] = np.inf
        return cluster, best, taken


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = _matrix(batch["v"], size)
            cluster, _, _ = shared.value.nearest(x)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = shared.value.nearest(_matrix(batch["v"], size))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, start: Column, folder: str, k: int = K, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for each vector of `vectors` (vec_id, embedding), and the final centroids.

    The k vectors with the smallest `start` are the first centroids, in that order.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == size) & countable(F.col("embedding")))
    kept = store(kept.select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("v")), folder, "vectors")
    first = [r["v"] for r in kept.select(start.alias("_s"), "v").orderBy("_s", "v").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.array(first, np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = kept.select("v").mapInArrow(_sums(shared, size), "cluster long, n long, sums array<long>")
        total = F.sum(F.col("x").cast("decimal(38,0)"))
        added = sums.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(total.alias("x"), F.sum("n").alias("n"))
        for r in added.collect():  # k times `size` rows at most
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        shared.destroy()
    shared = spark.sparkContext.broadcast(VantageTree(centroids))
    return kept.mapInArrow(_assigned(shared, size), "vec_id long, cluster int, distance long"), centroids.tolist()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    folder = workspace(spark, "op12")
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"), start, folder)
    assigned = store(assigned, folder, "assigned")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    added = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(named, "cluster")  # k rows
    added = added.crossJoin(added.agg(F.sum("cluster_inertia").alias("inertia")))  # with one row
    return assigned.join(F.broadcast(added), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, size: int = SIZE) -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"flat AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, vec_id FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})",
        "m0 AS MATERIALIZED (SELECT c, i, x AS m FROM c0 JOIN flat USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((x - m) * (x - m))::BIGINT AS d FROM flat JOIN m{r} USING (i) GROUP BY vec_id, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"n{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN flat USING (vec_id) GROUP BY c, i)")
            floor = "s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END"
            steps.append(f"m{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE {floor} END AS m FROM m{r} LEFT JOIN n{r} USING (c, i))")
    last = f"(SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, "
        f"sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN {last} USING (c)"
    )


ORACLE_SQL = _oracle()
