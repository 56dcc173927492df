"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the model holds a whitespace marker after another character, no merge can cross
from a word into the marker that follows it, so a text's ids are those of its marked words (a run of
markers and what follows up to the next marker), one after the other. In the same way a word is cut
where no piece can cross: between characters of different groups, a group being what the model's pieces
link by neighbourhood (letters of a script, punctuation).

Texts are read once, in blocks of about `BLOCK` characters: a block numbers its distinct words, the
commonest first, and codes its documents by these places. Its words go to parts by their hash, one row
a block and part; a part meets its words from all blocks, segments each distinct one once with the library, and
returns the ids of each block's words. With them the blocks' codes become ids by position. Codes stay
where they are: their table is bucketed by block, so only words and ids are shuffled.

Words, codes and ids travel packed (zstandard), since a row a word would take several times the disk
of the texts. A word is there once a block that holds it, so a word in every text is no hot key, and
nothing is broadcast. Parts are as many as hold at most `PART` characters each, were no word repeated.

Defined results: a row of the input is a row of the result, repeated and null ids included; a null or
empty text has the begin and end ids alone. A model with a piece across a marker, without the marker
before a text or without pieces for bytes gets whole texts as its words, with the same results.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import short_lived_shuffles, table, workspace

MARK = "▁"
#: Characters of a block (a longer document is a block of its own) and of a part; words taken from a text at once.
BLOCK, PART, WORDS = 8 << 20, 4 << 20, 1 << 17
#: Buckets of the blocks' table at most.
BUCKETS = 50_000
#: A block's own row among those of its parts.
CODES = -1
ROWS = "block long, part long, packed binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("packed", pa.binary())])


@cache
def processor(model: str):
    """The library's processor, once a worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def groups(pieces: list[str]) -> list[str]:
    """Characters that pieces link by neighbourhood, markers aside, as groups of more than one or of one that stands beside itself."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while above.setdefault(c, c) != c:
            c = above[c]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            above[top(a)] = top(b)
    found: dict[str, list[str]] = {}
    for c in sorted(above):
        found.setdefault(top(c), []).append(c)
    return ["".join(g) for g in found.values()]


class Words:
    """How a model's texts fall into words that can be segmented alone; `apart` is False where they don't."""

    #: A character before words without a marker, which no piece may hold.
    GUARD = "\n"

    def __init__(self, sp):
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        probe = "a  b c "  # markers are put before the text, kept in runs and at its end
        marked = "".join(sp.id_to_piece(i) for i in sp.encode(probe)) == MARK + probe.replace(" ", MARK)
        inside = [p.lstrip(MARK) for p in pieces]
        bytes_ = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.apart = marked and bytes_ and not any(MARK in p or self.GUARD in p for p in inside)
        held = "|".join(f"[{re.escape(g)}]+" for g in sorted(groups(inside), key=len, reverse=True))
        self.find = re.compile(f"{MARK}*(?:{held + '|' if held else ''}[^{MARK}])|{MARK}+").finditer
        self.sp, self.mark, self.guard = sp, sp.piece_to_id(MARK), len(sp.encode(self.GUARD))

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of words, or of whole texts where the model needs them."""
        if not self.apart:
            return self.sp.encode(words, num_threads=1)
        # the library puts the first marker itself, but not before an empty text
        found = self.sp.encode([w[1:] if w[0] == MARK else self.GUARD + w for w in words], num_threads=1)
        return [[self.mark] if w == MARK else ids if w[0] == MARK else ids[self.guard :] for w, ids in zip(words, found, strict=True)]

    def code(self, text: str, book: Numbered) -> array:
        """The numbers in `book` of a text's words."""
        out = array("I")
        if not self.apart:
            out.append(book[text])
        elif text:
            words = self.find(MARK + text.replace(" ", MARK))
            while part := [m[0] for m in islice(words, WORDS)]:
                out.extend(map(book.__getitem__, part))
        return out


@cache
def words_of(model: str) -> Words:
    return Words(processor(model))


class Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as all lowest bytes, then all second ones and so on: small numbers leave whole planes empty."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(*things) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(pickle.dumps(things, protocol=5))


def joined(words: list[str]) -> bytes:
    """Words between bytes that UTF-8 doesn't hold."""
    return b"\xff".join(w.encode() for w in words)


def split(words: bytes) -> list[str]:
    return [w.decode() for w in words.split(b"\xff")]


def unpack(packed: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _block_rows(block: int, book: Numbered, codes: array, ids: list, sizes: list[int], parts: int) -> pa.RecordBatch:
    """The codes of a block's documents and, by part, its words with their places."""
    numbers = np.frombuffer(codes, np.uint32) if codes else np.empty(0, np.uint32)
    order = np.argsort(-np.bincount(numbers, minlength=len(book)), kind="stable")
    place = np.empty(len(book), np.uint32)
    place[order] = np.arange(len(book))
    rows = [(block, CODES, pack(ids, sizes, planes(place[numbers])))]
    words = np.array(list(book), dtype=object)[order]
    part = np.array([crc32(w.encode()) % parts for w in words], np.int64)
    by_part = np.argsort(part, kind="stable")
    for own in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        if len(own):
            rows.append((block, int(part[own[0]]), pack(planes(np.diff(own, prepend=0)), joined(words[own].tolist()))))
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)


def _blocks(model: str, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = words_of(model), TaskContext.get().partitionId() << 33
        book, ids, sizes, codes, held = Numbered(), [], [], array("I"), 0
        for batch in batches:
            for own, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py() or ""
                if ids and held + len(text) > size:
                    yield _block_rows(block, book, codes, ids, sizes, parts)
                    block += 1
                    book, ids, sizes, codes, held = Numbered(), [], [], array("I"), 0
                coded = words.code(text, book)
                ids.append(own.as_py())
                sizes.append(len(coded))
                codes.extend(coded)
                held += len(text)
        if ids:
            yield _block_rows(block, book, codes, ids, sizes, parts)

    return run


def _segments(model: str):
    """For the words of a part in each block their places, numbers of ids and ids; each distinct word is segmented once."""

    def run(rows: pa.Table) -> pa.Table:
        known, lists = Numbered(), []
        for packed in rows["packed"]:
            places, words = unpack(packed.as_py())
            lists.append((places, np.array([known[w] for w in split(words)], np.int64)))
        found = words_of(model).segment(list(known))
        n = np.array([len(x) for x in found], np.int64)
        flat, starts = np.fromiter((i for x in found for i in x), np.uint32, n.sum()), np.cumsum(n) - n
        out = [pack(places, planes(n[own]), planes(flat[spread(starts[own], n[own])])) for places, own in lists]
        return pa.table([rows["block"], rows["part"], pa.array(out, pa.binary())], schema=_SCHEMA)

    return run


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _by_position(begin: list[int], end: list[int]):
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        ids, sizes, codes = unpack(block["packed"][0].as_py())
        codes = from_planes(codes)
        places, lengths, pieces = [], [], []
        for packed in words["packed"]:
            for held, one in zip((places, lengths, pieces), unpack(packed.as_py()), strict=True):
                held.append(from_planes(one))
        flat = np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32)
        n, starts = (np.zeros(sum(map(len, places)), np.int64) for _ in range(2))
        if places:
            at, own = np.concatenate([np.cumsum(x) for x in places]), np.concatenate(lengths).astype(np.int64)
            n[at], starts[at] = own, np.cumsum(own) - own
        out, first = [], 0
        for size in sizes:
            words = codes[first : first + size]
            first += size
            out.append(np.concatenate([begin, flat[spread(starts[words], n[words])], end]).astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        values = np.concatenate(out) if out else np.empty(0, np.int32)
        return pa.table([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "piece_ids"])

    return run


def encode(docs: DataFrame, folder: str, model: str, begin_end: bool = True, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id and piece_ids, the ids of the whole text, for each row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # only the session's catalog knows of buckets, so the blocks are an external table there until it is read
    name = f"piece_blocks_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(_blocks(model, block, -(-total // part) or 1), ROWS)
    with short_lived_shuffles(spark):
        rows.write.bucketBy(min(-(-total // block) or 1, BUCKETS), "block").option("path", f"{folder}/{name}").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    codes, words = blocks.filter(F.col("part") == CODES), blocks.filter(F.col("part") != CODES)
    ids = words.groupBy("part").applyInArrow(_segments(model), ROWS)
    sp = processor(model)
    ends = ([sp.bos_id()], [sp.eos_id()]) if begin_end else ([], [])
    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_by_position(*ends), "doc_id long, piece_ids array<int>")


def decode(piece_ids: Column, model: str) -> Column:
    """The text of ids, as the library decodes them; null where they are null."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        sp = processor(model)
        return pd.Series([None if x is None else sp.decode(x.tolist()) for x in ids], dtype=object)

    return texts(piece_ids)


def little_endian(piece_ids: Column) -> Column:
    """Ids as unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.astype("<u4").tobytes() for x in ids], dtype=object)

    return packed(piece_ids)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents"), workspace(spark, "op13"), model)
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(little_endian(F.col("piece_ids")), 256).alias("ids_sha256"), F.sha2(decode(F.col("piece_ids"), model), 256).alias("decoded_sha256"),
    )
