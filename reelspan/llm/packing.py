"""Packing token sequences by the linear grouping scheme, with best fit for the small ones.

Lengths are whole numbers of at most `capacity`, so all planning needs is their histogram: at most
`capacity` counts, whatever the corpus holds. On it the driver
1. sorts the large lengths and cuts them into a few groups of equal cardinality, each rounded up to
   its longest member;
2. optimises the configurations of these few sizes: the linear program that covers all groups by the
   fewest sequences, with columns made by a knapsack on its dual prices; whole numbers of each
   configuration are taken, and the few documents left over are topped up one sequence at a time;
3. substitutes actual documents for rounded slots, longest first, which gives runs of sequences
   with the same space left;
4. gives the small lengths, longest first, to the sequences with the least space that still fits.
Plans with several numbers of groups and limits of what is large are made; the one with the fewest
sequences counts.
The plan is a list of rank ranges: the pieces of length l with ranks lo to hi-1 go to the sequences
from seq0 on, one each. Spark ranks the pieces within their length (by salted buckets, whose offsets
come from their counts), joins the plan, and sets offsets by a window over each sequence.

Defined results: null text is empty, so its only token is the end token. Rows that share a doc_id
are packed each. Full pieces are sequences of their own.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.common import store, table, workspace

CAPACITY, END = 1024, 2
#: Numbers of groups, and shares of the capacity from which a length is large, that plans are made with.
GROUPS, LARGE = (16, 32, 64), (1 / 4, 1 / 3, 7 / 16)
#: The vocabulary of byte_bpe_50k.json as ranks: the same ids (tests compare them), some ten times as fast.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the added tokens of byte_bpe_50k.json and their ids; in a text they stand for themselves.
ADDED = {"<|endoftext|>": 50256}
# Fixed value: the pattern by which this vocabulary's tokenizer cuts a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000
#: White space before white space: only there can a token of this vocabulary's pattern hold more of it
#: than one leading space. A comma or full stop after a letter begins a token.
CROSSING, STOPS = re.compile(r"\s\s"), ",."
ADDED_TOKEN = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")
_workers: dict[str, Tokens] = {}


class Words(dict):
    """Token ids, as bytes, of words that follow `lead`; learns what it doesn't know yet."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead
        self.stops = {x: encode(x) for x in STOPS}

    def __missing__(self, word: str) -> bytes:
        if word and word[-1] in STOPS and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self.stops[word[-1]]
        else:
            ids = self.encode(self.lead + word)
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Tokens:
    """Token ids as little-endian bytes, with a memory of words; tokens never cross single white space."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later, self.newline = Words(self._ids, ""), Words(self._ids, " "), self._ids("\n")

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes() if text else b""

    def document(self, text: str) -> bytes:
        """The ids of a text in which added tokens count: they end the text on either side of them."""
        if not any(token in text for token in ADDED):
            return self.encode(text)
        parts = ADDED_TOKEN.split(text)
        return b"".join(np.array([ADDED[x]], "<u4").tobytes() if x in ADDED else self.encode(x) for x in parts if x)

    def encode(self, text: str) -> bytes:
        """The ids of ordinary text."""
        if CROSSING.search(text):
            return self._ids(text)
        lines, later = [], self.later.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.first[first] + b"".join(map(later, rest)))
        return self.newline.join(lines)


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens.of(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = tokens.document(text.as_py() or "") + end
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    start, stop, piece = 0, first, 0
                    while start < n:
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in at most `groups` groups of equal cardinality, as runs (length, count)."""
    total = sum(counts.values())
    size, out, room = -(-total // groups) if total else 1, [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def fullest(sizes: list[int], most: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable choice of sizes that fits, with at most `most` of each."""
    best, took = np.zeros(capacity + 1), []
    for size, n, value in zip(sizes, most, values, strict=True):
        rows = [best]
        for k in range(1, min(n, capacity // size) + 1):
            row = np.full(capacity + 1, -np.inf)
            row[size * k :] = best[: capacity + 1 - size * k] + k * value
            rows.append(row)
        stack = np.array(rows)
        took.append(stack.argmax(0))
        best = stack.max(0)
    at, used = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        used[i] = int(took[i][at])
        at -= sizes[i] * used[i]
    return float(best[capacity]), used


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and how often the linear program uses them: the fewest sequences that cover `demand`."""
    n = len(sizes)
    basis = np.diag([float(min(capacity // s, max(d, 1))) for s, d in zip(sizes, demand, strict=True)])
    amount = np.array(demand, float)
    for _ in range(50 * n):  # ends far earlier: each round lowers the number of sequences or changes the basis
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)
        value, column = fullest(sizes, demand, prices, capacity)
        if value <= 1 + 1e-9:
            break
        x, d = inverse @ amount, inverse @ np.array(column, float)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(np.linalg.inv(basis) @ amount, 0)
    return [([int(round(v)) for v in basis[:, j]], float(x[j])) for j in range(n)]


def sequences_of(sizes: list[int], demand: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Configurations with whole numbers of uses that place all of `demand` exactly."""
    left = list(demand)
    for use, x in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]) if any(demand) else ():
        times = min([int(x + 1e-9), *(left[i] // k for i, k in enumerate(use) if k)])
        if times:
            left = [a - k * times for a, k in zip(left, use, strict=True)]
            yield use, times
    while any(left):  # what rounding down left over: the largest size with the fullest rest
        first = next(i for i, k in enumerate(left) if k)
        most = [k - (i == first) for i, k in enumerate(left)]
        _, use = fullest(sizes, most, np.array(sizes, float), capacity - sizes[first])
        use[first] += 1
        times = min(left[i] // k for i, k in enumerate(use) if k)
        left = [a - k * times for a, k in zip(left, use, strict=True)]
        yield use, times


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, large: tuple[float, ...] = LARGE) -> list[tuple[int, int, int, int]]:
    """Rank ranges (length, lo, hi, seq0) that place every piece of the histogram."""
    return min((plan_of(counts, capacity, n, int(capacity * share)) for n in groups for share in large), key=lambda p: p[0])[1]


def plan_of(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Sequences and rank ranges of the plan with that many groups."""
    out: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(counts, 0)
    spaces: list[tuple[int, int, int]] = []  # (space left, seq0, sequences), by space
    sequences = 0

    def place(length: int, n: int, seq0: int) -> None:
        out.append((length, used[length], used[length] + n, seq0))
        used[length] += n

    queues = grouped({k: n for k, n in counts.items() if k >= small and n}, groups)
    sizes = [q[0][0] for q in queues]
    for use, times in sequences_of(sizes, [sum(n for _, n in q) for q in queues], capacity):
        slots = [i for i, n in enumerate(use) for _ in range(n)]
        edges = {0, times}
        runs = []
        for i in slots:  # each slot takes the next `times` documents of its group
            at, own = 0, []
            while at < times:
                length, n = queues[i][0]
                take = min(n, times - at)
                own.append((at, at + take, length))
                queues[i][0] = (length, n - take)
                if n == take:
                    queues[i].pop(0)
                place(length, take, sequences + at)
                at += take
                edges.add(at)
            runs.append(own)
        cuts = sorted(edges)
        for a, b in zip(cuts, cuts[1:], strict=False):
            filled = sum(next(length for s, e, length in own if s <= a < e) for own in runs)
            if filled < capacity:
                insort(spaces, (capacity - filled, sequences + a, b - a))
        sequences += times
    for length in sorted((k for k in counts if k < small), reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(spaces, (length, -1, -1))
            if i == len(spaces):
                fresh = -(-n // (capacity // length))
                insort(spaces, (capacity, sequences, fresh))
                sequences += fresh
                continue
            space, seq0, many = spaces.pop(i)
            take = min(n, many)
            place(length, take, seq0)
            n -= take
            if many > take:
                insort(spaces, (space, seq0 + take, many - take))
            if space > length:
                insort(spaces, (space - length, seq0, take))
    return sequences, out


def packed(docs: DataFrame, folder: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = store(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), folder, "pieces")
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(256, -(-sum(counts.values()) // 1_000_000))
    rest = rest.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rest.groupBy("length", "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = rest.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_r"))
    # some thousand rows at most, by the histogram's size; as Arrow, since a list would start Python workers of another kind on the executors
    ranges = spark.createDataFrame(pa.table(np.array(plan(counts, capacity), np.int64).reshape(-1, 4).T.tolist(), pa.schema([(c, pa.int64()) for c in ("_length", "_lo", "_hi", "_seq0")])))
    placed = ranked.join(F.broadcast(ranges), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.col("_seq0") + F.col("_rank") - F.col("_lo"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank")
    placed = placed.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(names).unionByName(full.select(names))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence."""
    return packed(table(spark, sf_dir, "documents"), workspace(spark, "op10"), vocabulary_path())


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return packed(docs, workspace(spark, "packing"), vocabulary_path())
