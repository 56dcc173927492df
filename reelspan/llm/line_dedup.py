"""Line deduplication over levelled, sorted runs of line hashes.

Documents arrive in batches of ascending doc_id. A batch takes the first holder of each of its
line keys, anti-joins those keys against the runs written so far, and adds what is new as a run of
its own. When a level holds `fanout` runs they are merged into one run of the next level. Every key
thus stands in exactly one run, with the smallest doc_id that holds it, and a line stays if its
document is that holder.

A run is a table bucketed and sorted by (h1, h2). All runs have as many buckets as a batch's
aggregation has partitions, so an anti-join is a merge of a batch's partition with a run's bucket,
and a compaction a merge of equal buckets: neither shuffles a run again. Batches grow with the
cluster (`ROWS` documents a core), so their number follows from the corpus; there are `BATCHES` at
least.

Only (hash, first doc_id) pairs are shuffled, after a combine on the map side, so a line that a
third of all documents hold costs one row a task. The text moves once, to meet its own kept keys.

Defined results: a null or empty text is one empty line. Rows that share a doc_id are one document.
Rows with a null doc_id hold no key and lose no line. Keys under `min_chars` code points always stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import ASCII_SPACE, free_name, short_lived_shuffles, table, with_text, workspace

MIN_CHARS = 10
#: Batches at least, documents of a batch for each core, runs of a level that are merged into one of the next.
BATCHES, ROWS, FANOUT = 4, 200_000, 2
#: Documents whose keys a worker holds at a time.
PART = 500


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The comparable form of a line, or None where it is too short to count."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def hashed(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _keys_of(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                ids, counts, found = part.column(0), [], []
                for text in part.column(1):
                    own = {line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
                    counts.append(len(own))
                    found += own
                h = hashed(found)
                yield pa.record_batch([ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), h[:, 0].copy(), h[:, 1].copy()], schema=schema)

    return run


def _kept(min_chars: int):
    @F.pandas_udf("struct<n_lines: long, n_dropped: long, kept: string>")
    def run(text: pd.Series, kept: pd.Series, nameless: pd.Series) -> pd.DataFrame:
        rows = []
        for t, mine, all_stay in zip(text, kept, nameless, strict=True):
            lines = (t or b"").split(b"\n")
            keys = [None if all_stay else line_key(x, min_chars) for x in lines]
            h = hashed([k for k in keys if k is not None])[:, 0] if any(keys) else np.empty(0, np.int64)
            own, stays = iter(np.isin(h, mine if mine is not None else [])), []
            for line, key in zip(lines, keys, strict=True):
                if key is None or next(own):
                    stays.append(line)
            rows.append((len(lines), len(lines) - len(stays), b"\n".join(stays).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    return run


class LineRuns:
    """Sorted runs of (h1, h2, first_id) in levels; keys of different runs are disjoint."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, keys: DataFrame) -> DataFrame:
        """Only the session's catalog knows of buckets, so a run is an external table there until it is read."""
        name = f"line_run_{uuid.uuid4().hex}"
        with short_lived_shuffles(self.spark):
            keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay
        return run

    def add(self, firsts: DataFrame) -> None:
        """Merge-anti-joins a batch's keys with each run and adds the rest as a run of level 0."""
        for run in self.runs():
            firsts = firsts.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        new, level = self._write(firsts), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            new = self._write(reduce(self._merged, self.levels[level]))
            self.levels[level], level = [], level + 1

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs of disjoint keys, merged bucket by bucket."""
        both = a.join(b.withColumnRenamed("first_id", "_other").hint("merge"), ["h1", "h2"], "full_outer")
        return both.select("h1", "h2", F.coalesce("first_id", "_other").alias("first_id"))


def edges_of(docs: DataFrame, batches: int) -> list[int]:
    """Inner bounds of `batches` ranges of doc_id with about as many documents each; 0: by the corpus and the cluster."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    batches = batches or max(BATCHES, -(-ids.count() // (ROWS * docs.sparkSession.sparkContext.defaultParallelism)))
    if batches == 1:
        return []
    return sorted({int(x) for x in ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.2 / batches)})


def dedup_lines(docs: DataFrame, folder: str, min_chars: int = MIN_CHARS, batches: int = 0, fanout: int = FANOUT) -> DataFrame:
    """All rows of `docs` beside n_lines, n_dropped and kept in one struct column `_lines` (see `free_name`, as for all names here)."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    edges = [None, *edges_of(docs, batches), None]
    state = LineRuns(spark, folder, fanout)
    for low, high in zip(edges, edges[1:], strict=False):
        part = slim
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        keys = part.mapInArrow(_keys_of(min_chars), "doc_id long, h1 long, h2 long")
        state.add(keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id")))
    first, mine, out = (free_name(docs, x) for x in ("_first_id", "_kept", "_lines"))
    kept = reduce(DataFrame.unionByName, state.runs()).groupBy(F.col("first_id").alias(first)).agg(F.collect_list("h1").alias(mine))
    joined = docs.join(kept, docs["doc_id"] == kept[first], "left").drop(first)
    return joined.withColumn(out, _kept(min_chars)(F.col("text").cast("binary"), mine, F.col("doc_id").isNull())).drop(mine)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), workspace(spark, "op1"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines gone; no document goes."""
    out, lines = dedup_lines(docs, workspace(spark, "lines")), free_name(docs, "_lines")
    return with_text(out, F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col(f"{lines}.kept"))).select(docs.columns)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM cut),
held AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT keyed.*, first_id IS NULL OR first_id = doc_id AS stays
  FROM keyed LEFT JOIN held ON keyed.k = held.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
