"""What the training-data operators share: shared-folder tables, words, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frees a job's shuffle files when the job ends instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds what a Python worker is given at once: very long texts come in batches of fewer rows.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: A key that holds more than one row in SHARE is joined by broadcast: there can be SHARE such keys at most.
SHARE = 1000


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under the shared folder of spark.checkpoint.dir.

    Without that setting a local session (as in tests) gets a temporary folder; on a cluster it is an
    error, since a folder of one machine would lose rows. Also bounds the bytes of the batches that
    Python workers get in this session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-reelspan-")
        sc.setCheckpointDir(base)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes `df` as a Parquet table of the workspace and reads it back: lineage ends here."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    with short_lived_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of a workspace that no later step reads: what follows has its own tables and doesn't come back to them."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_shared(rows: DataFrame, shared: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """Left join of `rows` with `shared` (one row a key), whose column `copies` counts the rows of `rows` with that key.

    Keys with more than total / SHARE rows number SHARE at most, so they may be broadcast whatever the
    table's size; any other key has too few rows to matter to the task that gets it.
    """
    hot = F.col(copies) * SHARE > total
    often, seldom = shared.filter(hot).drop(copies), shared.filter(~hot).drop(copies)
    first = rows.join(F.broadcast(often), keys, "inner")
    rest = rows.join(F.broadcast(often.select(keys)), keys, "left_anti").join(seldom, keys, "left")
    return first.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with another text; n_chars, where there is one, follows."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
