"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import store


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and component (its least node) for every node of `edges` (a, b).

    A round takes the least label among a node and its neighbours, then the label's own label, so
    labels travel twice as far each round. Rounds end when none changes; each is a table of the
    workspace, so nothing is recomputed if an executor is lost.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, f"{name}-edges")
    labels = store(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_m"))
        new = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "_m").alias("label"))
        up = new.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        new = new.join(up, new["label"] == up["_n"]).select("node", "old", F.least("label", "_up").alias("label"))
        new = store(new, folder, f"{name}-{step}")
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")
