"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symgrove.session import scratch_path

# Query tables up to this many characters in all are broadcast. The largest
# table derived from them has one row per character.
BROADCAST_CHARS = 1 << 18


def fits_broadcast(texts: DataFrame, column: str, limit: int = BROADCAST_CHARS) -> bool:
    """True if the column's total length is within the limit; one number is fetched."""
    total = texts.agg(F.sum(F.length(column) + 1).alias("n")).first()["n"]
    return (total or 0) <= limit


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """The broadcast hint where the size was checked; otherwise Spark decides.

    Without the hint the joins are shuffles that adaptive execution may still
    turn into broadcasts or split where a key is skewed.
    """
    return F.broadcast(df) if small else df


def gathered(df: DataFrame, small: bool) -> DataFrame:
    """A measured small table in one partition, so that grouping it needs no shuffle; its scan stays spread."""
    return df.repartition(1) if small else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, so that what uses it several times has it made once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
