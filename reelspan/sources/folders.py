"""Folders for what queries write, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:  # a local session, as in tests; on a cluster a folder of one machine would lose rows
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-reelspan-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}"
