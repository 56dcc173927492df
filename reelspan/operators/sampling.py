"""Global ordinals, mixtures, chunks and rollouts, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def ordinal(rows: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """A dense number from 0 in the order (bucket, order): counts by bucket are cumulated, rows only ranked inside.

    `bucket` is a coarse form of the order's first key; it gives as many tasks as it has values.
    """
    marked = rows.withColumn("_bucket", bucket)
    before = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn("_base", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).drop("_n")  # a row a bucket
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return marked.withColumn("_r", inside).join(before, "_bucket").withColumn(name, F.col("_base") + F.col("_r")).drop("_bucket", "_r", "_base")


def even_chunks(numbered: DataFrame, ordinal_name: str, total: int, chunks: int) -> DataFrame:
    """chunk: contiguous parts whose sizes differ by at most one, the longer ones first."""
    small, longer = divmod(total, chunks)
    n = F.col(ordinal_name)
    edge = longer * (small + 1)
    chunk = F.when(n < edge, F.floor(n / (small + 1))).otherwise(longer + F.floor((n - edge) / max(small, 1)))
    return numbered.withColumn("chunk", chunk.cast("long"))


def mixture(rows: DataFrame, key: str) -> DataFrame:
    """Rows and realised share of each dataset."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    return counts.withColumn("ratio", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # a row a dataset


def rollouts(tasks: DataFrame, task: str, times: int, stride: int) -> DataFrame:
    """Each task `times` times, with rollout number, seed and id."""
    many = tasks.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return many.withColumn("seed", F.col(task) + F.col("rollout") * stride).withColumn("rollout_id", F.concat_ws(":", F.col(task).cast("string"), F.format_string("%02d", "rollout")))


def fixed_chunks(numbered: DataFrame, ordinal_name: str, size: int) -> DataFrame:
    """chunk: `size` rows in a row, the last chunk shorter."""
    return numbered.withColumn("chunk", F.floor(F.col(ordinal_name) / size))


def round_robin(numbered: DataFrame, ordinal_name: str, workers: int) -> DataFrame:
    return numbered.withColumn("worker", F.pmod(F.col(ordinal_name), F.lit(workers)))


def full_batches(numbered: DataFrame, ordinal_name: str, total: int, size: int, pad: bool) -> DataFrame:
    """Whole batches only: the rest is dropped, or (`pad`) filled up with the first rows again, numbered on.

    With fewer rows than are missing, the rows come round several times.
    """
    rest = total % size
    if not rest:
        return numbered
    if not pad:
        return numbered.filter(F.col(ordinal_name) < total - rest)
    missing, n = size - rest, F.col(ordinal_name)
    # row n fills the places total + n, 2 total + n, ... below total + missing
    last = F.floor((F.lit(total + missing - 1) - n) / total)
    again = numbered.withColumn("_k", F.explode(F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last))))
    return numbered.unionByName(again.withColumn(ordinal_name, n + F.col("_k") * total).drop("_k"))


def outcomes(rows: DataFrame, group: str, status: str, known: list[str]) -> DataFrame:
    """By group: the count of each known status, and of all others."""
    counts = [F.count_if(F.col(status) == k).alias(k) for k in known]
    return rows.groupBy(group).agg(*counts, F.count_if(~F.coalesce(F.col(status).isin(known), F.lit(False))).alias("other"))
