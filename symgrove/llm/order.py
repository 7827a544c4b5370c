"""Global places in an order, without one task that sorts or counts all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from symgrove.llm.tables import stored

_LOW = (1 << 33) - 1


def positions(rows: DataFrame, order: Sequence[str], label: str, name: str = "position") -> DataFrame:
    """rows, stored, with their places from 0 by ``order`` (nulls first).

    Ranges of the order are sorted by themselves; a row's place is that in its
    range plus the sizes of the ranges before, one number a range. Rows equal
    in all of ``order`` share a range: end it with a row number where many
    rows may be equal.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), label)
    task = F.shiftright("_id", 33)
    totals = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers per range: bounded by the number of shuffle partitions.
    shifts = totals.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return (placed.withColumn("_task", task).join(F.broadcast(shifts), "_task")
            .select(*rows.columns, (F.col("_shift") + F.col("_id").bitwiseAND(F.lit(_LOW))).alias(name)))


def running_sums(placed: DataFrame, columns: Sequence[str], slice_rows: int = 1 << 16, name: str = "position") -> DataFrame:
    """placed, rows with their places, with ``<column>_before``: sums over all rows before.

    Slices of places are summed by themselves and shifted by the slices before, one row a slice.
    """
    cut = placed.withColumn("_slice", F.floor(F.col(name) / slice_rows))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut.groupBy("_slice").agg(*[F.sum(c).alias(f"_all_{c}") for c in columns]).select(
        "_slice", *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_shift_{c}") for c in columns])
    before = Window.partitionBy("_slice").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(shifts), "_slice").select(
        *placed.columns, *[(F.col(f"_shift_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"{c}_before") for c in columns])


def row_id() -> Column:
    """A number for each row of a table as it is read, to tell equal rows apart."""
    return F.monotonically_increasing_id()


def rows_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a sorted partition, one after another."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024,
            weight: Callable[[tuple], int] = lambda row: 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``most`` rows, or of as much weight."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if heavy >= most:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)
