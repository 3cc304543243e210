"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
