"""Ranks of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, limit: int, rank: str) -> DataFrame:
    """The best ``limit`` a query by score, then uid, with 1-based ranks."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "uid")
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= limit)
