"""Run states over an unbounded stream of attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from symgrove.operators.runs import fold_runs
from symgrove.plans import manifest as m

RUN_BUCKETS = 64


def _bucket(run_id):
    return F.pmod(F.xxhash64(run_id), F.lit(RUN_BUCKETS))


def fold_stream(attempts: DataFrame, out: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Write the runs each batch changed; late attempts change them again.

    The fold is Spark's own streaming aggregation, so its state is one row per
    run and survives a lost executor through the checkpoint. Batches are kept
    under the query's id and their number, so several streams may fold into
    one table. After ``compact_every`` batches the rows that later ones
    replaced go.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, m.writer_of(batch, checkpoint)
        table = m.Manifest(spark, out)
        if table.settled(writer, str(batch_id)):
            return
        folder, version = m.new_folder(), m.new_version()
        _write(batch.withColumn("version", F.lit(version)), out, folder)
        rows = spark.read.parquet(f"{out}/runs/folder={folder}").count()
        table.publish(writer, str(batch_id), folder, {"rows": rows}, version=version)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_runs(spark, out, batch.schema)

    return fold_runs(attempts).writeStream.outputMode("update").foreachBatch(store) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write(rows: DataFrame, out: str, folder: str) -> None:
    rows.withColumn("bucket", _bucket("run_id")).repartition("bucket").sortWithinPartitions("bucket", "run_id") \
        .write.partitionBy("bucket").parquet(f"{out}/runs/folder={folder}")


def _read(spark: SparkSession, out: str, commits: Sequence[m.Commit], schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("version", T.LongType()),
                           T.StructField("folder", T.StringType()), T.StructField("bucket", T.IntegerType())])
    return m.read_folders(spark, f"{out}/runs", [c for c in commits if c.facts["rows"]], stored).drop("folder")


def _current(rows: DataFrame) -> DataFrame:
    fields = [n for n in rows.columns if n not in ("run_id", "bucket")]
    return rows.groupBy("bucket", "run_id").agg(F.max_by(F.struct(*fields), "version").alias("r")) \
        .select("bucket", "run_id", "r.*")


def compact_runs(spark: SparkSession, out: str, schema: T.StructType, least: int = 2) -> bool:
    """Merge batches that no replay can change into one row per run, that of the latest batch."""
    table = m.Manifest(spark, out)
    closed = table.compactable(least)
    if not closed:
        return False
    folder = m.new_folder()
    _write(_current(_read(spark, out, closed, schema)).drop("bucket"), out, folder)
    rows = spark.read.parquet(f"{out}/runs/folder={folder}").count() if any(c.facts["rows"] for c in closed) else 0
    table.publish(m.COMPACTION, folder, folder, {"rows": rows}, [c.folder for c in closed])
    return True


def latest_runs(spark: SparkSession, out: str, runs: Sequence[object] | None = None) -> DataFrame:
    """Current state of every run, or of the given ones, whose buckets alone are read: its latest batch's row."""
    live = [c for c in m.Manifest(spark, out).live if c.facts["rows"]]
    if not live:
        raise ValueError(f"no runs are stored under {out}")
    schema = spark.read.parquet(f"{out}/runs/folder={live[-1].folder}").drop("version", "bucket").schema
    rows = _read(spark, out, live, schema)
    if runs is not None:
        wanted = spark.createDataFrame([(r,) for r in runs], T.StructType([schema["run_id"]]))
        buckets = [r[0] for r in wanted.select(_bucket("run_id")).distinct().collect()]     # at most RUN_BUCKETS
        rows = rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted.distinct()), "run_id", "left_semi")
    return _current(rows).drop("bucket", "version")
