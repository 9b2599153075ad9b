"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of keys and short texts, some tens of MB at most.
FEW = 100_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
