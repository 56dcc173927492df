"""Readers and sinks: Parquet tables, JSON-lines manifests with quarantine, file listings, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("verbs", T.ArrayType(T.StringType())),
        T.StructField("nouns", T.ArrayType(T.StringType())),
        T.StructField("adjectives", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
SPLITS = "map<string, struct<points: array<int>, type: array<int>, instructions: array<string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """Rows dealt out by key for heavy work on each, about `each` a task and two tasks a core at least.

    A small file is few tasks, and Spark joins the parts of a shuffle by their bytes before rows have grown a hundredfold.
    """
    return rows.repartition(max(-(-rows.count() // each), 2 * rows.sparkSession.sparkContext.defaultParallelism), *keys)


def read_manifest(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """JSON lines as typed rows beside their file; malformed lines fail, or keep their text in _corrupt_record."""
    reader = spark.read.schema(MANIFEST).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the malformed lines."""
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), rows.filter(F.col("_corrupt_record").isNotNull()).select("source_file", "_corrupt_record")


def list_files(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True, prune: str | None = None) -> DataFrame:
    """path, length and modification time of files by extension; `prune` is a pattern of paths to leave out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root).select("path", "length", "modificationTime")
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return files.filter(~F.col("path").rlike(prune)) if prune else files


def newest_run(files: DataFrame, run_pattern: str) -> DataFrame:
    """The run folder, by `run_pattern`'s first group, whose files are newest."""
    runs = files.withColumn("run", F.regexp_extract("path", run_pattern, 1)).filter("run <> ''")
    return runs.groupBy("run").agg(F.max("modificationTime").alias("at")).agg(F.max_by("run", F.struct("at", "run")).alias("run"))


def read_split_points(spark: SparkSession, path: str) -> DataFrame:
    """episode_key, points, type and instructions of a JSON object of episodes."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", SPLITS)).alias("episode_key", "_s")).select("episode_key", "_s.*")


def episode_files(spark: SparkSession, root: str) -> DataFrame:
    """Annotation files named <prefix>_ep_<six digits>.npy, with prefix and number."""
    name = r"([^/]+)_ep_(\d{6})\.npy$"
    files = list_files(spark, root, ["npy"]).filter(F.col("path").rlike(name))
    return files.select("path", "length", F.regexp_extract("path", name, 1).alias("prefix"), F.regexp_extract("path", name, 2).cast("int").alias("episode_number"))


def write_index(index: DataFrame, path: str, keys: list[str]) -> None:
    """An index as Parquet, range-partitioned and sorted by its keys."""
    index.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
