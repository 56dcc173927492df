"""Vector columns by dimension: masked statistics, merging, normalising, slice errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_statistics(rows: DataFrame, vector: str, mask: Column, keys: list[str]) -> DataFrame:
    """Mean and population deviation of each dimension over masked rows, in long form."""
    long = rows.filter(mask).select(*keys, F.posexplode_outer(vector).alias("dim", "x"))
    return long.filter("x IS NOT NULL").groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("num_rows"))


def merged_statistics(stats: DataFrame, weight: Column, mode: str = "linear") -> DataFrame:
    """By dimension: weighted means of mean and std (linear), or the pooled population deviation."""
    w, total = F.col("_w"), F.sum("_w")
    rows = stats.withColumn("_w", weight)
    mean = F.sum(w * F.col("mean")) / total
    if mode == "linear":
        std = F.sum(w * F.col("std")) / total
    else:
        std = F.sqrt(F.greatest(F.sum(w * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / total - mean * mean, F.lit(0.0)))
    return rows.groupBy("dim").agg(mean.alias("mean"), std.alias("std"))


def as_arrays(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Long statistics as arrays in order of dimension: a row a key."""
    packed = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    out = stats.groupBy(*keys).agg(packed.alias("_p"))
    return out.select(*keys, F.transform("_p", lambda r: r["mean"]).alias("means"), F.transform("_p", lambda r: r["std"]).alias("stds"))


def slice_errors(pairs: DataFrame, x: str, y: str, slices: DataFrame) -> DataFrame:
    """Mean squared difference by named slice (name, start, stop) of the dimensions."""
    gaps = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    long = pairs.select(F.posexplode(gaps).alias("dim", "d"))
    by_dim = long.groupBy("dim").agg(F.sum("d").alias("_s"), F.count("d").alias("_n"))  # a row a dimension
    joined = by_dim.join(F.broadcast(slices), (F.col("dim") >= F.col("start")) & (F.col("dim") < F.col("stop")))
    return joined.groupBy("name").agg((F.sum("_s") / F.sum("_n")).alias("mse"), F.sum("_n").alias("terms"))
