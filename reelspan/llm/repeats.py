"""Windows of a fixed number of units that also start in a document with a smaller doc_id.

Shared by the byte and the word operator. Comparing all windows of all documents would shuffle
every position, so it is done in steps that each keep every match:

1. Winnowing. A window of `size` units holds `size - k + 1` grams of k units; its least gram hash
   depends on the window's content alone, so equal windows have equal least grams. Each document
   gives its distinct least grams (about one in twenty units).
2. Grams that only one document has are left out (one aggregation with a combine on the map side,
   then a join back that adaptive execution may split).
3. Exact copies of an earlier document go whole. Of the others, the runs of windows behind the other grams, with their units, go to the group of their gram.
   Runs that an earlier document in the same batch holds unit for unit are settled before the shuffle.
   Where a gram is in over `hot` documents its windows go by the 128-bit hash of their whole content,
   as (hash, least document) combined on the map side: no task gets the copies of one passage.
4. A group compares its windows exactly (`flags`), by the method of the operator.
5. The covered spans meet their documents once, on (doc_id, hash of the text).

Rows with a null doc_id take no part and lose nothing. Rows that share a doc_id never count as an
earlier document for each other. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm.common import discard, free_name, join_shared, store

#: Documents that share a gram from which its windows are settled by their hashes: a group's units stay within a few MB.
HOT = 20_000
#: Windows of one run that travel together, and bytes of units that a task compares at once.
RUN, CHUNK = 64, 6 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a gram's hash. Grams that collide share a group, whose windows are compared in full.
BYTES = 6

Units = Callable[[bytes], np.ndarray]
Flags = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def word_units(text: bytes) -> np.ndarray:
    """64-bit hashes of the words; bytes.split() cuts at the contract's white space."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    rest, n = width - step, len(x) - width + 1
    return np.minimum(out[:n], out[rest : rest + n])


def least_grams(units: np.ndarray, size: int, k: int) -> np.ndarray:
    """For each window of `size` units the least mixed hash of its k-grams."""
    if len(units) < size:
        return np.empty(0, np.uint64)
    part = units.astype(np.uint64)
    part = (part + np.uint64(1)) * MULT
    part ^= part >> np.uint64(29)
    done, length, power, left = None, 1, MULT, k
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                done = part if done is None else done[: len(part) - (k & (length - 1))] * power + part[k & (length - 1) :]
            left >>= 1
            if not left:
                break
            part, power, length = part[:-length] * power + part[length:], power * power, length * 2
        done = done ^ (done >> np.uint64(31))
        done = done * np.uint64(0xBF58476D1CE4E5B9)
        done ^= done >> np.uint64(30)
    return _sliding_min(done >> np.uint64(8 * (8 - BYTES)), size - k + 1)


def packed(grams: np.ndarray) -> bytes:
    return grams.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view(np.int64)


def runs_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of windows with the same least gram, cut at RUN windows."""
    n = len(least)
    cut = np.ones(n, bool)
    cut[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(cut)
    lengths = np.diff(np.append(first, n))
    if lengths.max(initial=0) > RUN:
        within = np.arange(n) - np.repeat(first, lengths)
        first = np.flatnonzero(within % RUN == 0)
        lengths = np.diff(np.append(first, n))
    return first, lengths


def _gram_lists(units: Units, size: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = units(text or b"")
                if doc is not None and len(own) >= size:
                    rows.append((doc, th, xxhash.xxh3_64_intdigest(text) - (1 << 63), len(own), packed(np.unique(least_grams(own, size, k)))))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _explode_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2).to_pylist()
        counts = np.array([len(x) // BYTES for x in lists], np.int64)
        row = pa.array(np.repeat(np.arange(len(lists)), counts))
        grams = unpacked(b"".join(lists))
        step = 1 << 18
        for i in range(0, len(grams), step):
            at = row[i : i + step]
            yield pa.record_batch([pa.array(grams[i : i + step]), batch.column(0).take(at), batch.column(1).take(at)], names=["g", "doc_id", "th"])


RUN_SCHEMA = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("units", pa.binary())])


def _kept_runs(text: bytes, grams: list[int], units: Units, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a text, and gram, start and length of its runs behind `grams`."""
    own = units(text)
    least = least_grams(own, size, k)
    first, lengths = runs_of(least)
    keys = least[first].view(np.int64)
    at = np.flatnonzero(np.isin(keys, np.array(grams, np.int64)))
    return own, keys[at], first[at], lengths[at]


def _hot_windows(units: Units, size: int, k: int):
    """Windows behind crowded grams: h1, h2 (hash of the content), doc_id, th, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, text, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, _, first, lengths = _kept_runs(text, hot, units, size, k)
                starts = np.concatenate([np.arange(s, s + n) for s, n in zip(first, lengths, strict=True)])
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(own[s : s + size].tobytes()) for s in starts), "<i8").reshape(-1, 2)
                same = np.full(len(starts), doc, np.int64), np.full(len(starts), th, np.int64)
                yield pa.record_batch([h[:, 0].copy(), h[:, 1].copy(), *same, starts.astype(np.int32)], names=["h1", "h2", "doc_id", "th", "start"])

    return run


def _shared_runs(units: Units, size: int, k: int):
    """Runs of windows behind shared grams; those settled in the batch come without units."""

    def of(text: bytes, grams: list[int]) -> Iterator[tuple[int, int, int, bytes]]:
        own, keys, first, lengths = _kept_runs(text, grams, units, size, k)
        for key, start, n in zip(keys.tolist(), first.tolist(), lengths.tolist(), strict=True):
            yield key, start, n, own[start : start + n - 1 + size].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0])
            seen: dict[bytes, int] = {}
            out: list[tuple] = []
            held = 0
            for doc, th, text, grams in rows:
                last = -1  # place in `out` of this document's last settled run
                for key, start, n, content in of(text, grams):
                    if seen.setdefault(content, doc) < doc:
                        if last >= 0 and out[last][3] + out[last][4] == start:
                            out[last] = (*out[last][:4], out[last][4] + n, None)
                        else:
                            last = len(out)
                            out.append((hash((doc, th)), doc, th, start, n, None))
                    else:
                        out.append((key, doc, th, start, n, content))
                        held += len(content)
                if held > CHUNK or len(out) > 100_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN_SCHEMA.types, strict=True)], schema=RUN_SCHEMA)
                    out, held, last = [], 0, -1
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN_SCHEMA.types, strict=True)], schema=RUN_SCHEMA)

    return run


def _spans(doc: np.ndarray, th: np.ndarray, start: np.ndarray, row: np.ndarray, flagged: np.ndarray, size: int) -> pa.RecordBatch:
    """Flagged windows, in order of (row, start), as spans of covered units."""
    at = np.flatnonzero(flagged)
    head = np.ones(len(at), bool)
    head[1:] = (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(at)) - 1
    f = at[first]
    return pa.record_batch([doc[row[f]], th[row[f]], start[f].astype(np.int32), (start[at[last]] + size).astype(np.int32)] if len(at) else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)], names=["doc_id", "th", "s", "e"])


def _matched(flags: Flags, size: int, dtype: type):
    """Streams rows sorted by key; compares chunks that end where a key ends."""
    width = np.dtype(dtype).itemsize

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, th = (t.column(c).to_numpy() for c in ("key", "doc_id", "th"))
        start, n = t.column("start").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64)
        done = t.column("units").is_null().to_numpy()
        if done.any():
            yield pa.record_batch([doc[done], th[done], start[done].astype(np.int32), (start[done] + n[done] - 1 + size).astype(np.int32)], names=["doc_id", "th", "s", "e"])
        live = ~done
        edge = np.flatnonzero(np.append(True, key[live][1:] != key[live][:-1]))
        group = np.repeat(np.diff(np.append(edge, live.sum())), np.diff(np.append(edge, live.sum()))) if live.any() else np.empty(0, int)
        rows = np.flatnonzero(live)[group > 1]
        if not len(rows):
            return
        units = np.frombuffer(b"".join(t.column("units").take(pa.array(rows)).to_pylist()), dtype)
        doc, th, start, n = doc[rows], th[rows], start[rows], n[rows]
        base = np.cumsum(n - 1 + size) - (n - 1 + size)
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        flagged = flags(units, base[row] + within, doc[row], size)
        yield _spans(doc, th, start[row] + within, row, flagged, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.nbytes for x in held) < CHUNK * min(width, 4):
                continue
            t = pa.concat_tables(held).combine_chunks()
            keys = t.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from settle(t.slice(0, cut))
                t = t.slice(cut)
            held = [t]
        if held:
            yield from settle(pa.concat_tables(held).combine_chunks())

    return run


def _cut(words: bool):
    @F.pandas_udf("struct<n: long, n_removed: long, n_spans: long, kept: binary>")
    def run(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(text, spans, strict=True):
            t = t or b""
            units = t.split() if words else t
            if own is None or not len(own):
                rows.append((len(units), 0, 0, b" ".join(units) if words else t))
                continue
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in own):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            stays, at = [], 0
            for s, e in merged:
                stays.append(units[at:s])
                at = e
            stays.append(units[at:])
            kept = b" ".join(w for x in stays for w in x) if words else b"".join(stays)
            rows.append((len(units), sum(e - s for s, e in merged), len(merged), kept))
        return pd.DataFrame(rows, columns=["n", "n_removed", "n_spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, folder: str, size: int, k: int, words: bool, flags: Flags, hot: int = HOT) -> DataFrame:
    """All rows of `docs` with one more column `_cut` (see `free_name`): n, n_removed, n_spans and the kept bytes."""
    units, dtype = (word_units, np.uint64) if words else (byte_units, np.uint8)
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    lists = store(slim.select("doc_id", "th", "text").mapInArrow(_gram_lists(units, size, k), "doc_id long, th long, check long, n int, grams binary"), folder, "grams")
    # a table of its own, so that the join below may split the rows of a text with very many copies
    texts = store(lists.groupBy("th", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"), folder, "texts")
    copies = store(lists.join(texts, ["th", "check"]).filter("doc_id > lo").select("doc_id", "th", F.lit(0).alias("s"), F.col("n").alias("e")), folder, "copies")
    grams = lists.select("doc_id", "th", "grams").mapInArrow(_explode_grams, "g long, doc_id long, th long")
    counted = grams.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    shared = store(counted.filter("lo < hi").select("g", (F.col("n") > hot).alias("crowded")), folder, "shared")
    found = grams.join(shared.hint("shuffle_hash"), "g")
    listed = F.collect_list(F.when(~F.col("crowded"), F.col("g"))).alias("grams"), F.collect_list(F.when(F.col("crowded"), F.col("g"))).alias("hot")
    per_doc = store(found.groupBy("doc_id", "th").agg(*listed), folder, "found").join(copies, ["doc_id", "th"], "left_anti")
    discard(docs.sparkSession, folder, "grams", "texts", "shared")  # before the texts and their runs are shuffled, where disk use is highest
    runs = slim.join(per_doc.filter(F.size("grams") > 0), ["doc_id", "th"]).select("doc_id", "th", "text", "grams").mapInArrow(_shared_runs(units, size, k), "key long, doc_id long, th long, start int, n int, units binary")
    spans = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_matched(flags, size, dtype), "doc_id long, th long, s int, e int").unionByName(copies)
    crowded = slim.join(per_doc.filter(F.size("hot") > 0), ["doc_id", "th"]).select("doc_id", "th", "text", "hot")
    hot_windows = store(crowded.mapInArrow(_hot_windows(units, size, k), "h1 long, h2 long, doc_id long, th long, start int"), folder, "hot")
    firsts = hot_windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("*").alias("_n")).filter("_first < _last").drop("_last")
    later = join_shared(hot_windows, store(firsts, folder, "firsts"), ["h1", "h2"], "_n", hot_windows.count()).filter("doc_id > _first")
    islands = later.withColumn("_i", F.col("start") - F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("start")))
    islands = islands.groupBy("doc_id", "th", "_i").agg(F.min("start").alias("s"), (F.max("start") + size).alias("e")).drop("_i")
    spans = store(spans.unionByName(islands).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("_spans")), folder, "spans")
    discard(docs.sparkSession, folder, "found", "copies", "hot", "firsts")
    th, doc, own, mine, out = (free_name(docs, x) for x in ("_th", "_doc", "_own", "_spans", "_cut"))
    keyed = docs.withColumn(th, F.xxhash64(F.col("text").cast("binary")))
    joined = keyed.join(spans.withColumnsRenamed({"doc_id": doc, "th": own, "_spans": mine}), (F.col("doc_id") == F.col(doc)) & (F.col(th) == F.col(own)), "left")
    return joined.withColumn(out, _cut(words)(F.col("text").cast("binary"), mine)).drop(th, doc, own, mine)
