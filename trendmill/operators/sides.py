"""Sides of joins: broadcast after a check of their size, or never."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``rows`` rows, which one small job tells; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast, for one that grows with the tables.

    Spark takes a table for as large as its files, so it would send rows that are many
    times larger than their files through the driver.
    """
    return df.hint("merge")
