"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

Writing. A payload is a string, so a record is one too, and the four bytes that end a record are the
writer's line separator: files (gzipped whole) come from Spark's own writer, on any file system that Spark
reaches, and failed tasks leave nothing behind. The first page (by page_id) of each payload is a `response`
with an HTTP block; others are `revisit` records with the HTTP headers only. The join that tells them
apart is with the digests that pages share, written first: below the broadcast threshold no payload is
shuffled; above it adaptive execution may split the pages of a hot payload.

Reading. A file has at most `RECORDS` records and, but for a single longer one, `FILE_BYTES` of payload
(pages of one size class are written together, fewer a file the longer they are), so a task can hold it.
Gzip files of one member or of one a record are read alike, and so are plain ones. The task lists every place
where the magic `WARC/1.0` or `WARC/1.1` stands and where a record beginning there would end: candidate pairs of
record and successor. Pointer jumping from the file's start (each round doubles the jump) keeps the
reachable ones; magic inside a payload is on no chain from the start and falls away. A chain that
does not end where the file ends raises an error, as does a payload that misses its digest.

Header names may be in any case. Records that aren't responses or revisits, and ids that this writer
didn't give, are read as well: page_id is null there and record_id holds the id as it stands.

Defined results: null html is an empty payload. Rows with the page_id of the first page are
responses too. A null page_id comes after all others; a null url leaves its header out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import BATCH_BYTES, store, table, workspace

#: Records of one archive file at most.
RECORDS = 2048
#: Payload bytes of one archive file at most, unless a single record is longer.
FILE_BYTES = 128 << 20
CRLF, MAGIC = "\r\n", rb"WARC/1\.[01]\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:reelspan:page:"


def base32_of_hex(digest: str) -> Column:
    @F.pandas_udf("string")
    def run(hexadecimal: pd.Series) -> pd.Series:
        return hexadecimal.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())

    return run(digest)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record(date: str) -> Column:
    """The whole record but for the four bytes that end it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _header("Content-Length", F.col("_bytes").cast("string")), F.lit(CRLF))
    block = F.when(F.col("_revisits"), http).otherwise(F.concat(http, F.col("_payload")))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        _header("WARC-Type", F.when(F.col("_revisits"), "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), own, F.lit(">"))),
        F.coalesce(_header("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")), F.lit("")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex("_sha1"))),
        F.when(F.col("_revisits"), F.concat(_header("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("_first").cast("string"), F.lit(">"))), _header("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def size_classes(records: int, file_bytes: int) -> list[tuple[int, int]]:
    """(largest payload, records a file) of each size class: sixteen times fewer records each, down to one."""
    out = []
    while records > 1:
        out.append((file_bytes // records, records))
        records //= 16
    return [*out, (1 << 62, 1)]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records: int = RECORDS, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes page_id, url and html of `pages` as archive files into the folder `path`, a folder of it for each size class."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_payload"))
    rows = rows.withColumn("_bytes", F.octet_length("_payload")).withColumn("_sha1", F.sha1(F.col("_payload").cast("binary")))
    shared = rows.filter(F.col("_bytes") >= min_bytes).groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    # a table, so that its size is known: a small one is broadcast, and payloads aren't shuffled
    spark = pages.sparkSession
    shared = store(shared.filter("_n > 1 AND _first IS NOT NULL").drop("_n"), workspace(spark, "warc"), "shared")
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low = -1
    for high, most in size_classes(records, file_bytes):
        if low < longest:
            own = rows.filter((F.col("_bytes") > low) & (F.col("_bytes") <= high))
            typed = own.join(shared, "_sha1", "left").withColumn("_revisits", F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")))
            typed.select(_record(date).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).option("compression", "gzip").text(f"{path}/to={high}")
        low = high


def reachable(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Which candidate records lie on the chain from offset 0; the chain has to reach `end`."""
    n = len(offsets)
    jump = np.searchsorted(offsets, successors)
    there = (jump < n) & (offsets[np.minimum(jump, n - 1)] == successors) if n else np.zeros(0, bool)
    jump = np.append(np.where(there, jump, n), n)  # place n: no further record
    on = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        on[0] = True
    for _ in range(max(n, 1).bit_length()):
        on[jump[on]] = True
        jump = jump[jump]
    last = np.flatnonzero(on[:n])
    if end and (not len(last) or successors[last[-1]] != end):
        raise ValueError(f"broken archive: the chain of {len(last)} records does not end at byte {end}")
    return on[:n]


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, record_id string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, whole = pa.string(), pa.int64()
    schema = pa.schema(list(zip([c.split()[0] for c in COLUMNS.split(", ")], (whole, whole, text, text, whole, text, pa.binary(), text), strict=True)))

    def page(urn: str | None) -> int | None:
        """The number in an id of this writer's; None for any other."""
        found = re.fullmatch(f"<{ID}(-?\\d+)>", urn or "")
        return int(found[1]) if found else None

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            found = []
            for m in re.finditer(MAGIC, data):
                body = data.find(b"\r\n\r\n", m.start()) + 4
                length = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", data[m.start() : body - 2]) if body > 3 else None
                if length:
                    found.append((m.start(), body, int(length[1])))
            places = np.array([x[0] for x in found], np.int64)
            ends = np.array([b + n + 4 for _, b, n in found], np.int64)
            rows, held = [], 0
            for i in np.flatnonzero(reachable(places, ends, len(data))):
                start, body, length = found[i]
                head, block = _headers(data[start : body - 4]), data[body : body + length]
                kind, digest, size, payload = head.get("warc-type"), head.get("warc-payload-digest"), None, block
                if kind in ("response", "revisit"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = _headers(http).get("content-length", "")
                    size = int(stated) if stated.isdigit() else None
                size = len(payload) if size is None else size
                digest = digest.removeprefix("sha1:") if digest else None
                # only a bare SHA-1 in base32 can be held against the payload; others stay as they are stated
                if kind == "response" and digest and re.fullmatch("[A-Z2-7]{32}", digest) and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"broken archive: the payload at byte {start} misses its digest")
                own = head.get("warc-record-id")
                row = (page(own), size, digest, kind, page(head.get("warc-refers-to")), head.get("warc-target-uri"), payload, own)
                rows.append(row)
                held += len(payload)
                if held > BATCH_BYTES:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, record_id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_records, COLUMNS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages."""
    path = workspace(spark, "op3")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
        for i in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM hashed JOIN firsts USING (h)
"""
