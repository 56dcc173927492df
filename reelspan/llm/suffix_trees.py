"""Word-level substring deduplication by suffix trees over groups that fit a task.

Suffixes meet in groups by a gram that any two of them with equal windows share (see `repeats`), and
by the whole window where many documents share that gram, so that a group fits a task.
A task builds the levels of its suffix tree by naming: the name of the 2m words at a position is
the name of the pair of names of m words there and m words on. Positions with one name at a depth
are the leaves below one internal node of at least that depth; nodes as deep as the window with
leaves in two documents are the repeats, maximal ones once overlapping windows are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import table, workspace
from reelspan.llm.repeats import cut_repeats

SIZE, GRAM = 50, 8


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, numbered in their order."""
    return np.unique(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def deep_nodes(units: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The tree node, at depth `size` words, above each suffix."""
    names, depth = np.unique(units, return_inverse=True)[1], 1
    while depth * 2 <= size:
        names, depth = _names(names[:-depth], names[depth:]), depth * 2
    return _names(names[starts], names[starts + size - depth])


def under_earlier(units: np.ndarray, starts: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """Has the deep node above each suffix a leaf in an earlier document?"""
    node = deep_nodes(units, starts, size)
    first = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, node, docs)
    return first[node] < docs


def dedup_words(docs: DataFrame, folder: str, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """`docs` with `_cut`: n (words), n_removed, n_spans, kept."""
    return cut_repeats(docs, folder, size, gram, words=True, flags=under_earlier)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    out = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"), workspace(spark, "op8"))
    return out.select("doc_id", F.col("_cut.n").alias("n_words"), "_cut.n_removed", F.sha2("_cut.kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH given AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM given),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + {SIZE - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS p FROM given)),
firsts AS (SELECT t, min(doc_id) AS d FROM windows GROUP BY t HAVING min(doc_id) < max(doc_id)),
later AS (SELECT doc_id, p FROM windows JOIN firsts USING (t) WHERE d < doc_id),
covered AS (SELECT doc_id, p, word, max(CASE WHEN later.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS gone
            FROM words LEFT JOIN later USING (doc_id, p)),
cut AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM given LEFT JOIN cut USING (doc_id)
"""
