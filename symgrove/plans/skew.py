"""Exact ordered numbering of groups that may be very large, and tasks of equal weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symgrove.session import scratch_path


# Rows of one key and slice that are sorted by one task; more are numbered over ranges measured from the data.
SLICE_ROWS = 1 << 20


def _numbered(rows: DataFrame, part: Sequence[str], order: Sequence[str], shifts: DataFrame) -> DataFrame:
    """rows of (key, slice) groups with ``_local``, their number in the group, and the group's ``_shift``."""
    shifts = shifts.select(*[F.col(n).alias(f"_of_{n}") for n in part], "_shift")
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in part]
    local = W.partitionBy(*part).orderBy(*order)
    return rows.join(shifts, same).withColumn("_local", F.row_number().over(local)).drop(*[f"_of_{n}" for n in part])


def _numbered_by_range(rows: DataFrame, part: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """The same for large groups: ranges of the order sorted by themselves, then shifted by the ranges before."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "numbered-ranges")
    hot = F.broadcast(hot.select(*[F.col(n).alias(f"_of_{n}") for n in part], "_shift"))
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in part]
    large = rows.join(hot, same).drop(*[f"_of_{n}" for n in part])
    by = [*part, *order]
    ranged = large.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path).withColumns({
        "_task": F.shiftright("_id", 33), "_id": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    # A row per group and range: where the group begins there, and how many of its rows lie in ranges before.
    met = ranged.groupBy(*part, "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*part).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    met = F.broadcast(met.select(*[F.col(n).alias(f"_of_{n}") for n in part], F.col("_task").alias("_of__task"), "_first",
                                 F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in (*part, "_task")]
    return ranged.join(met, same).withColumn("_local", F.col("_before") + F.col("_id") - F.col("_first") + 1) \
        .drop("_id", "_task", "_first", "_before", *[f"_of_{n}" for n in (*part, "_task")])


def sliced_row_number(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                      slice_of: Column, name: str) -> DataFrame:
    """Row numbers within ``keys`` by ``order``, without sorting a key at once.

    ``slice_of`` cuts the order into pieces and must never fall along it, for
    example the day of a leading timestamp. Each (key, slice) is numbered by
    itself and shifted by the sizes of the slices before it, so a key that
    holds a third of all rows is spread over its slices. Slices are measured:
    one of more than SLICE_ROWS rows, a run of which all attempts fall on one
    day, is numbered over ranges of its rows instead. The counts shuffle one
    row per (key, slice), the rows themselves shuffle once. Null keys and null
    slices keep their rows; null slices come first.
    """
    part = [*keys, "_slice"]
    sliced = rows.withColumn("_slice", slice_of)
    sizes = sliced.groupBy(*part).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*part, "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    large = F.col("_n") > SLICE_ROWS
    if shifts.where(large).isEmpty():
        numbered = _numbered(sliced, part, order, shifts)
    else:
        # Fewer large groups than rows / SLICE_ROWS.
        numbered = _numbered(sliced, part, order, shifts.where(~large)).unionByName(
            _numbered_by_range(sliced, part, order, shifts.where(large)))
    return numbered.withColumn(name, (F.col("_shift") + F.col("_local")).cast("int")).drop("_slice", "_shift", "_local")


# What opening a file costs, in bytes, and the bytes of a task: within these bounds as many as four tasks a core make.
OPEN_BYTES = 64 << 10
LEAST_TASK, MOST_TASK = 4 << 20, 256 << 20


def byte_packed(rows: DataFrame, size: str, key: Sequence[str], tasks: int | None = None) -> DataFrame:
    """rows in partitions of about equal sums of ``size``, each large row in one of its own.

    The rows are summed up in hashed parts, each by itself, and shifted by the
    sums of the parts before; a row goes to the partition in which its sum
    begins. Rows above a partition's weight are few and get numbers of their
    own. Unknown sizes count as what opening a file costs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    weighed = rows.withColumn("_weight", F.coalesce(F.col(size), F.lit(0)) + OPEN_BYTES)
    total = weighed.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    most = total // tasks + 1 if tasks else min(max(total // (4 * cores), LEAST_TASK), MOST_TASK)
    parted = weighed.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(4 * cores)))
    huge = F.col("_weight") >= most
    alone = weighed.where(huge).count()
    sums = parted.where(~huge).groupBy("_part").agg(F.sum("_weight").alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per part.
    shifts = F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift")))
    before = W.partitionBy("_part").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)
    usual = parted.where(~huge).withColumn("_before", F.coalesce(F.sum("_weight").over(before), F.lit(0))).join(shifts, "_part") \
        .withColumn("_slot", F.floor((F.col("_before") + F.col("_shift")) / most))
    slots = total // most + 1
    # Not more of these than total / most, so one window holds them.
    own = parted.where(huge).withColumn("_slot", F.row_number().over(W.orderBy(*key)) + slots - 1)
    packed = usual.drop("_before", "_shift").unionByName(own.withColumn("_slot", F.col("_slot").cast("bigint")))
    return packed.repartitionById(int(slots + alone), F.col("_slot").cast("int")).select(*rows.columns)
