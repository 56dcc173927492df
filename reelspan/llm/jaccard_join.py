"""Self-join of documents on the Jaccard similarity of their word shingles, by count vectors.

Shingle hashes fall into groups, and a document is the point of its groups' counts. The overlap of
two documents is at most the sum, over groups, of the smaller count; a pair whose sum is too small
for the threshold can't link. Points are indexed by trees of boxes with several levels (a box knows
its upper corner, its sizes and its components); a query descends where a box passes the bound, and
pairs that survive at the points are verified on the shingles.

One tree over the whole corpus can't prune: unrelated long documents have near-equal counts in every
coordinate of a coarse grouping, so a box of many points covers them all. The same groups give the
exact way to split it. Two sets that link differ in at most d = n (1 - t) / t shingles, so with more
than d groups some whole groups agree, in count and in content. Every document names its d + 1
largest groups (by count, then hash: an order all share), and two that link share a name. A tree is
built over the documents that share one.

1. Sets with equal content are one node, combined on the map side. Nodes name their groups; names of
   one node only drop out.
2. Each node is tried with the first node of its trees, `STARS` of them at most: pairs that pass the
   bound are verified, and links are joined into components. Most trees are then of one component.
3. In the others, nodes outside the tree's most common component ask the tree. Asking nodes and held
   nodes are dealt into blocks of about `BLOCK`, so a task holds one block of either at a time,
   however many share a name. A pair is given by the tree of the least open name that both have, and
   pairs across components that pass the bound are verified.
   No link between components can be missed; links inside one don't change it.

Defined results: texts without words have an empty set, link with nothing and are components of
their own. Rows that share a doc_id are one node that links if any of its texts does. Rows with a
null doc_id take no part; their component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import join_shared, store, table, workspace
from reelspan.llm.components import components

WIDTH, THRESHOLD = 4, 85
#: Coordinates of the count vectors, children of a box, nodes of a block, and trees' first nodes that a node is tried with.
GROUPS, FAN, BLOCK, STARS = 256, 16, 1024, 4
#: Least names of a node that go with each of its rows, so that most pairs come under their least shared name alone.
TOLD = 64
#: Pairs whose vectors are compared at once, and pairs that are held before they are handed on.
CHUNK, HELD = 4096, 100_000
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(h: np.ndarray, key: np.uint64 = K1) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * key
        h = (h ^ (h >> np.uint64(29))) * K2
        return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.lower() and bytes.split() are the contract's."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(len(h), width), np.uint64)
        for i in range(min(width, len(h))):
            out = mixed(out * K3 + h[i : i + n], K1)
    return np.unique(out)


def group_names(h: np.ndarray, threshold: int) -> np.ndarray:
    """Names of the largest groups of a set, in each size class where a partner may stand."""
    n, names = len(h), []
    spare = n * (100 - threshold) // threshold
    own = n.bit_length() - 1
    content = mixed(h, K3)
    for level in (own, own + 1):
        if level > own and 100 * n < threshold << level:
            break
        many = -(-(2 << level) * 115 * (100 - threshold) // (100 * threshold)) + 1
        group = ((h >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)  # grows with h, so groups are runs
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.zeros(many, np.uint64)
        sums = np.zeros(many, np.uint64)
        at = group[first].astype(np.int64)
        sizes[at] = np.diff(np.append(first, n)).astype(np.uint64)
        sums[at] = np.add.reduceat(content, first)
        with np.errstate(over="ignore"):
            name = mixed(sums + mixed(np.arange(many, dtype=np.uint64) * K1 + sizes * K2 + np.uint64(level + 1)))
        names.append(name[np.lexsort((name, -sizes.astype(np.int64)))[: spare + 1]])
    return np.concatenate(names)


def count_vector(h: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them; its width follows from the length."""
    counts = np.bincount((mixed(h) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def points_of(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of the widest type among them."""
    widths = np.array([len(v) // GROUPS for v in vectors])
    out = np.empty((len(vectors), GROUPS), f"u{widths.max(initial=1)}")
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(vectors[i] for i in at), f"u{width}").reshape(-1, GROUPS)
    return out


def least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(1, dtype=np.int64)


def overlap_needed(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return -(-(n + m) * threshold // (100 + threshold))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _sets(width: int, threshold: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("vec", pa.binary()), ("names", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_set(text.as_py() or b"", width)
                if len(h):
                    f1, f2 = (int(np.bitwise_xor.reduce(mixed(h, K2)).view(np.int64)), int(mixed(h, K3).sum().view(np.int64)))
                    rows.append((doc, len(h), f1, f2, count_vector(h), group_names(h, threshold).tobytes()))
                else:
                    rows.append((doc, 0, 0, 0, b"", b""))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _explode_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1).to_pylist()
        row = pa.array(np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]))
        names = np.frombuffer(b"".join(lists), np.int64)
        for i in range(0, len(names), 1 << 18):
            at = row[i : i + (1 << 18)]
            yield pa.record_batch([pa.array(names[i : i + (1 << 18)]), batch.column(0).take(at)], names=["name", "rep"])


class Trees:
    """Box trees over the points of many keys at once; a box has FAN children at most, all of its key."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comp: np.ndarray, key: np.ndarray):
        """`key` numbers the trees from 0."""
        band = (np.log(np.maximum(sizes, 1)) / np.log(1.1)).astype(np.int64)  # points in one box are alike in size, then in where their counts lie
        parts = points.reshape(len(points), 4, -1).sum(2, dtype=np.int64) // np.maximum(np.sqrt(sizes).astype(np.int64) // 2, 1)[:, None]
        self.order = np.lexsort((parts[:, 2], parts[:, 1], parts[:, 0], band, key))
        p, n, c, k = points[self.order], sizes[self.order], comp[self.order], key[self.order]
        self.points, self.sizes, self.comp = p, n, c
        self.levels: list[tuple[np.ndarray, ...]] = []  # by level: first child, end, corner, least and greatest size, least and greatest component
        corner, low, high, cmin, cmax = p, n, n, c, c
        while True:
            within = np.arange(len(k)) - np.searchsorted(k, k)
            first = np.flatnonzero(within % FAN == 0)
            corner, low, high = np.maximum.reduceat(corner, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            cmin, cmax = np.minimum.reduceat(cmin, first), np.maximum.reduceat(cmax, first)
            self.levels.append((first, np.append(first[1:], len(k)), corner, low, high, cmin, cmax))
            k = k[first]
            if len(np.unique(k)) == len(k):
                self.roots = k  # ascending: a root a key
                return

    def search(self, points: np.ndarray, sizes: np.ndarray, comp: np.ndarray, key: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of points of other components, in their key's tree, that pass the bound."""
        step = max(1, (1 << 18) // max(len(self.points), 1))
        for at in range(0, len(points), max(step, 64)):
            q = np.arange(at, min(at + max(step, 64), len(points)))
            node = np.searchsorted(self.roots, key[q])
            there = (node < len(self.roots)) & (self.roots[np.minimum(node, len(self.roots) - 1)] == key[q])
            q, node = q[there], node[there]
            for first, end, corner, low, high, cmin, cmax in reversed(self.levels):
                near = (high[node] * 100 >= sizes[q] * threshold) & (low[node] * threshold <= sizes[q] * 100) & ((cmin[node] != comp[q]) | (cmax[node] != comp[q]))
                q, node = self._bounded(q[near], node[near], points, corner, overlap_needed(sizes[q[near]], low[node[near]], threshold))
                many = end[node] - first[node]
                q, start = np.repeat(q, many), np.repeat(first[node] - np.cumsum(many) + many, many)
                node = start + np.arange(len(start))
            near = (self.comp[node] != comp[q]) & (self.sizes[node] * 100 >= sizes[q] * threshold) & (self.sizes[node] * threshold <= sizes[q] * 100)
            q, node = q[near], node[near]
            q, node = self._bounded(q, node, points, self.points, overlap_needed(sizes[q], self.sizes[node], threshold))
            yield q, self.order[node]

    @staticmethod
    def _bounded(q: np.ndarray, node: np.ndarray, points: np.ndarray, corner: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        passed = [np.flatnonzero(least_sums(points[q[i : i + CHUNK]], corner[node[i : i + CHUNK]]) >= need[i : i + CHUNK]) + i for i in range(0, len(q), CHUNK)]
        at = np.concatenate(passed) if passed else np.empty(0, int)
        return q[at], node[at]


def _crossing(threshold: int):
    """From rows sorted by (name, q, h): surviving pairs of nodes. Holds whole keys, which are bounded, of one batch."""

    def settle(t: pa.Table, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = t.column("names").combine_chunks()
        edge, names, name = own.offsets.to_numpy(), own.values.to_numpy(), t.column("name").to_numpy()

        def least(x: int, y: int) -> bool:
            """Is no smaller shared name known? Where a pair's least shared name lies beyond what its nodes tell, it comes more than once."""
            shared = np.intersect1d(names[edge[x] : edge[x + 1]], names[edge[y] : edge[y + 1]], assume_unique=True)
            return not len(shared) or shared[0] >= name[x]

        rep, comp, n = (t.column(c).to_numpy() for c in ("rep", "comp", "n"))
        points, asks = points_of(t.column("vec").to_pylist()), t.column("asks").to_numpy(zero_copy_only=False)
        q, h = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(q) and len(h):
            for a, b in Trees(points[h], n[h], comp[h], key[h]).search(points[q], n[q], comp[q], key[q], threshold):
                first = np.fromiter((least(x, y) for x, y in zip(q[a], h[b], strict=True)), bool, len(a))
                x, y = rep[q[a[first]]], rep[h[b[first]]]
                yield np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            found.clear()
            return pa.record_batch([np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1])], names=["a", "b"])

        def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("name", "q", "h")])
            key = np.cumsum(np.append(False, (keys[:, 1:] != keys[:, :-1]).any(0)))
            for a, b in settle(t.combine_chunks(), key):
                if len(a):
                    found.append(np.stack([a, b]))
                    if sum(x.shape[1] for x in found) > HELD:
                        yield handed()

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = t.num_rows - 1
            whole = np.logical_or.reduce([t.column(c).to_numpy() != t.column(c)[last].as_py() for c in ("name", "q", "h")])
            cut = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
            if cut:
                yield from settled(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from settled(rest)
        if found:
            yield handed()

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of `pairs` (a, b: doc_ids) whose texts link."""

    @F.pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        last, h, out = None, None, []
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, h = x, shingle_set(x or b"", width)
            out.append(linked(h, shingle_set(y or b"", width), threshold))
        return pd.Series(out, dtype=bool)

    texts = docs.select(F.col("doc_id").alias("_d"), F.col("text").cast("binary").alias("_t"))
    nodes = pairs.select(F.col("a").alias("_d")).union(pairs.select("b")).distinct()
    texts = texts.join(nodes, "_d", "left_semi")
    left = pairs.join(texts.withColumnsRenamed({"_d": "a", "_t": "_ta"}), "a")
    both = left.join(texts.withColumnsRenamed({"_d": "b", "_t": "_tb"}), "b")
    return both.filter(links("_ta", "_tb")).select("a", "b").distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Those of `pairs` whose summed least counts reach the threshold."""

    @F.pandas_udf("boolean")
    def near(va: pd.Series, na: pd.Series, vb: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(least_sums(points_of(list(va)), points_of(list(vb))) >= overlap_needed(na.to_numpy(), nb.to_numpy(), threshold))

    slim = nodes.select("rep", "n", "vec")
    out = pairs.join(slim.withColumnsRenamed({"rep": "a", "n": "_na", "vec": "_va"}), "a").join(slim.withColumnsRenamed({"rep": "b", "n": "_nb", "vec": "_vb"}), "b")
    return out.filter(near("_va", "_na", "_vb", "_nb")).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, folder: str, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sets = store(source.mapInArrow(_sets(width, threshold), "doc_id long, n long, f1 long, f2 long, vec binary, names binary"), folder, "sets")
    ids = ["f1", "f2", "n"]
    alike = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*ids).agg(F.min_by(F.struct("doc_id", "vec", "names"), "doc_id").alias("_first"), F.count("*").alias("copies"))
    nodes = store(alike.select(*ids, "copies", F.col("_first.doc_id").alias("rep"), "_first.vec", "_first.names"), folder, "nodes")
    named = nodes.select("rep", "names").mapInArrow(_explode_names, "name long, rep long")
    shared = store(named.groupBy("name").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("name", "lo"), folder, "shared")
    members = store(named.join(shared.hint("shuffle_hash"), "name").select("name", "rep", "lo"), folder, "members")

    hubs = members.filter("rep <> lo").groupBy("rep").agg(F.slice(F.sort_array(F.collect_set("lo")), 1, STARS).alias("hubs"))
    stars = hubs.select(F.explode("hubs").alias("a"), F.col("rep").alias("b"))
    tried = store(_bounded(stars, nodes, threshold), folder, "stars")
    links = store(_verified(tried, docs, width, threshold), folder, "links")
    labels = components(links, folder, "first")

    placed = members.join(labels, members["rep"] == labels["node"], "left").select("name", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = store(placed, folder, "placed")
    by_comp = placed.groupBy("name", "comp").agg(F.count("*").alias("_c"))
    open_names = by_comp.groupBy("name").agg(F.sum("_c").alias("_k"), F.max(F.struct("_c", "comp")).alias("_main")).filter(F.col("_k") > F.col("_main._c"))
    open_names = open_names.select("name", F.col("_main.comp").alias("main"), F.ceil((F.col("_k") - F.col("_main._c")) / BLOCK).cast("int").alias("qs"), F.ceil(F.col("_k") / BLOCK).cast("int").alias("hs"))
    opened = placed.join(open_names, "name").groupBy("rep", "comp").agg(F.collect_list(F.struct("name", "main", "qs", "hs")).alias("_open"))
    opened = opened.join(nodes.select("rep", "n", "vec"), "rep").withColumn("names", F.slice(F.sort_array(F.transform("_open", lambda x: x["name"])), 1, TOLD))
    rows = opened.select("rep", "comp", "n", "vec", "names", F.explode("_open").alias("_o")).select("*", "_o.*").drop("_o")
    own, every = F.xxhash64("rep"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.filter("comp <> main").select("*", F.pmod(own, F.col("qs")).cast("int").alias("q"), every("hs").alias("h"), F.lit(True).alias("asks"))
    held = rows.select("*", every("qs").alias("q"), F.pmod(own, F.col("hs")).cast("int").alias("h"), F.lit(False).alias("asks"))
    keys = ["name", "q", "h"]
    dealt = asking.unionByName(held).select(*keys, "rep", "comp", "n", "vec", "names", "asks").repartition(*keys).sortWithinPartitions(*keys)
    crossing = dealt.mapInArrow(_crossing(threshold), "a long, b long").distinct()
    crossing = store(crossing.join(tried, ["a", "b"], "left_anti"), folder, "crossing")
    more = store(_verified(crossing, docs, width, threshold), folder, "more")

    # a doc_id of several texts: its texts' nodes are one
    total, copied = sets.count(), nodes.filter("copies > 1").select(*ids, "rep", "copies")
    held_by = join_shared(sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", *ids), copied, ids, "copies", total)
    again = held_by.filter("rep <> doc_id").select("doc_id", "rep").join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    joined = store(again.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), folder, "joined")
    if more.limit(1).count() or joined.limit(1).count():
        labels = components(links.union(more).union(joined), folder, "second")

    of_copies = copied.join(labels, copied["rep"] == labels["node"], "left").select(*ids, "copies", F.coalesce("component", "rep").alias("_shared"))
    own = join_shared(sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", *ids), of_copies, ids, "copies", total)
    own = own.join(labels, own["doc_id"] == labels["node"], "left").select("doc_id", "n", F.coalesce("_shared", "component", "doc_id").alias("component_id"))
    alone = sets.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return own.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), workspace(spark, "op2"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of their group of near copies; those without words or doc_id stay."""
    found = jaccard_components(docs, workspace(spark, "near"), width, threshold)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def oracle_components(documents: str, width: int, threshold: int) -> str:
    """DuckDB common table expressions; the last, `grouped`, has doc_id, n_shingles, component_id."""
    return rf"""
    jw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t-\r]+'), lambda w: w <> '') AS w FROM {documents}),
    js AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(len(w) - {width - 1}), lambda i: array_to_string(w[i + 1 : i + {width}], ' '))) END AS sh FROM jw),
    jn AS (SELECT doc_id, len(sh) AS n FROM js),
    jt AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM js),
    jp AS (SELECT a.doc_id AS x, b.doc_id AS y FROM jt a JOIN jt b ON a.s = b.s AND a.doc_id < b.doc_id
           WHERE 100 * a.n >= {threshold} * b.n AND 100 * b.n >= {threshold} * a.n
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {threshold} * (a.n + b.n - count(*))),
    je AS (SELECT x, y FROM jp UNION ALL SELECT y, x FROM jp),
    reach(x, y) AS (SELECT doc_id, doc_id FROM jn UNION SELECT reach.x, je.y FROM reach JOIN je ON reach.y = je.x),
    grouped AS (SELECT jn.doc_id, n AS n_shingles, least_id AS component_id
           FROM jn JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON x = jn.doc_id)"""


ORACLE_SQL = f"WITH RECURSIVE {oracle_components('documents', WIDTH, THRESHOLD)}\nSELECT doc_id, n_shingles, component_id FROM grouped\n"
