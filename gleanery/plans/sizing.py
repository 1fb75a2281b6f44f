"""Checks that decide whether a side may be broadcast, and what to do when it may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the relation has at most ``max_rows`` rows; reads no more than one row beyond the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row-count check; otherwise the plain relation, joined by shuffle with AQE skew splits."""
    return F.broadcast(df) if fits(df, max_rows) else df
