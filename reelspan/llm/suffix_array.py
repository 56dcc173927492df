"""Exact byte-level deduplication by longest previous factors.

The windows that can repeat meet in groups (see `repeats`). A group's windows are put in suffix order
(truncated at the window's length, ties in document order), with the common prefix of each with its
neighbour. The previous and the next smaller position of a suffix are the nearest before and after
it, in suffix order, that lie in an earlier document; they are found by pointer jumping, which takes
the least common prefix on the way along. The larger of the two is the longest previous factor.
Where it is as long as the window, the window is a later copy and goes; the first stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import table, workspace
from reelspan.llm.repeats import cut_repeats

SIZE, GRAM = 50, 20


def common_prefixes(ranked: np.ndarray, size: int) -> np.ndarray:
    """Bytes that each row (big-endian words) shares with the row before it; 0 for the first."""
    differ = ranked[1:] ^ ranked[:-1]
    word = (differ != 0).argmax(1)
    rest = differ[np.arange(len(word)), word]
    equal = np.where(rest == 0, size, 8 * word)
    for byte in range(1, 8):
        equal += (rest != 0) & (rest < np.uint64(1) << np.uint64(64 - 8 * byte))
    return np.append(0, np.minimum(equal, size))


def smaller_before(docs: np.ndarray, prefix: np.ndarray, size: int) -> np.ndarray:
    """Bytes shared with the nearest suffix before, in this order, of an earlier document.

    A search ends where it holds less than `size`: what it returns there is an upper bound below `size`.
    """
    at, reach = np.arange(len(docs)) - 1, prefix.copy()
    going = np.flatnonzero((at >= 0) & (reach >= size))
    going = going[docs[at[going]] >= docs[going]]
    while len(going):
        over = at[going]  # the one jumped over has found none smaller than itself in between
        at[going], reach[going] = at[over], np.minimum(reach[going], reach[over])
        going = going[(at[going] >= 0) & (reach[going] >= size)]
        going = going[docs[at[going]] >= docs[going]]
    return np.where(at >= 0, reach, 0)


def longest_previous(units: np.ndarray, starts: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """For each suffix start the bytes it shares with one of an earlier document, up to `size` (exact there)."""
    words = np.zeros((len(starts), -(-size // 8) * 8), np.uint8)
    words[:, :size] = np.lib.stride_tricks.sliding_window_view(units, size)[starts]
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((docs, *words.T[::-1]))
    prefix, own = common_prefixes(words[order], size), docs[order]
    before = smaller_before(own, prefix, size)
    after = smaller_before(own[::-1], np.append(0, prefix[:0:-1]), size)[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def later_copies(units: np.ndarray, starts: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    return longest_previous(units, starts, docs, size) >= size


def dedup_bytes(docs: DataFrame, folder: str, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """`docs` with `_cut`: n (bytes), n_removed, n_spans, kept."""
    return cut_repeats(docs, folder, size, gram, words=False, flags=later_copies)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents."""
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), workspace(spark, "op6"))
    return out.select("doc_id", F.col("_cut.n").alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, hex(coalesce(text, '')) AS x FROM documents),
chunks AS (SELECT doc_id, off, substr(x, 2 * off + 1, {2 * (1000 + SIZE - 1)}) AS part
           FROM (SELECT doc_id, x, unnest(range(0, strlen(x) // 2, 1000)) AS off FROM given)),
spots AS (SELECT doc_id, off + i AS p, substr(part, 2 * i + 1, 2) AS b, substr(part, 2 * i + 1, {2 * SIZE}) AS w
          FROM (SELECT doc_id, off, part, unnest(range(least(1000, strlen(part) // 2))) AS i FROM chunks)),
firsts AS (SELECT w, min(doc_id) AS d FROM spots WHERE strlen(w) = {2 * SIZE} GROUP BY w HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, p, b, coalesce(d < doc_id, false) AS later FROM spots LEFT JOIN firsts USING (w)),
covered AS (SELECT doc_id, p, b, max(CASE WHEN later THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT *, gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) = 0 AS opens FROM covered),
cut AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (gone = 0) AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, strlen(text) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM given LEFT JOIN cut USING (doc_id)
"""
