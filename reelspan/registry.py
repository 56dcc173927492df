"""All registered queries over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspan.plans import answers, cuts, more, motion, robot, scenes, state, streams, windows  # noqa: F401  they register their queries
from reelspan.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of a vocabulary by word type."""
    return QUERIES["diversity_report"](spark, sf_dir)
