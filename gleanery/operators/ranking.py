"""Per-group top-k shared by every retriever."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of each group with their rank.

    ``row_number() <= k`` is planned as a group limit on both sides of the exchange, so each task ships at most ``k``
    rows per group and no task ever sorts a whole group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
