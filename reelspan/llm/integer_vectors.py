"""Vectors as exact integers, for the operators whose results hang on exact scores and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond this size could carry scores and squared distances of 64 components out of a long.
LARGEST = 1 << 27


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, taken as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("int"))


def countable(vector: Column, scale: int = 256) -> Column:
    """Whether a vector is there and has only finite components whose integers stay within `LARGEST`."""
    inside = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST / scale), F.lit(False)))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))
