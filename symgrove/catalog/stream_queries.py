"""Registered streaming queries F12 and L8; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.catalog import run_queries, views as v
from symgrove.operators.search import search_symbols
from symgrove.plans.storage import read_nodes, read_table
from symgrove.session import scratch_path
from symgrove.streaming.folding import fold_stream, latest_runs
from symgrove.streaming.ingest import ingest_stream


def _parts(spark: SparkSession) -> tuple[int, int]:
    """Files to write, and files per batch so that a stream has a few batches."""
    parts = max(spark.sparkContext.defaultParallelism, 3)
    return parts, -(-parts // 3)


def append_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "ingest-stream")
    parts, per_batch = _parts(spark)
    v.code_files(spark, sf).select(
        F.lit("code").alias("repo"), "rel_path", F.col("content").cast("binary").alias("content")) \
        .repartition(parts, "rel_path").write.parquet(f"{base}/drop")
    ingest_stream(spark, f"{base}/drop", f"{base}/table", f"{base}/checkpoint",
                  files_per_batch=per_batch, id_path=F.col("rel_path")).awaitTermination()
    return read_nodes(spark, f"{base}/table").select(
        "node_id", "node_type", "file_path", "symbol_name", "source_code", "language")


def append_stream_repos(spark: SparkSession, sf: str) -> DataFrame:
    """Two repositories that hold the same paths, streamed into one table."""
    base = scratch_path(spark, "ingest-stream")
    parts, per_batch = _parts(spark)
    v.code_files(spark, sf).select(
        F.explode(F.array(F.lit("east"), F.lit("west"))).alias("repo"), "rel_path",
        F.col("content").cast("binary").alias("content")) \
        .repartition(parts, "repo", "rel_path").write.parquet(f"{base}/drop")
    ingest_stream(spark, f"{base}/drop", f"{base}/table", f"{base}/checkpoint",
                  files_per_batch=per_batch).awaitTermination()
    return read_nodes(spark, f"{base}/table").groupBy("repo", "language").agg(
        F.count("*").alias("n_nodes"), F.count_distinct("node_id").alias("n_ids"),
        F.count_distinct("file_path").alias("n_files"))


def append_stream_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams with checkpoints of their own append halves of the files to one table, which is then searched."""
    base = scratch_path(spark, "ingest-streams")
    files = v.code_files(spark, sf).select(
        F.lit("code").alias("repo"), "rel_path", F.col("content").cast("binary").alias("content"))
    half = F.pmod(F.xxhash64("rel_path"), F.lit(2))
    for i in (0, 1):
        files.where(half == i).repartition(2, "rel_path").write.parquet(f"{base}/drop-{i}")
        ingest_stream(spark, f"{base}/drop-{i}", f"{base}/table", f"{base}/checkpoint-{i}",
                      files_per_batch=2, id_path=F.col("rel_path")).awaitTermination()
    nodes, index = read_table(spark, f"{base}/table")
    return search_symbols(v.search_queries(spark, sf), nodes, index=index).select("qid", "pos", "node_id", "symbol_name", "file_path")


def fold_run_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "fold-stream")
    parts, per_batch = _parts(spark)
    rows = run_queries.attempts(spark, sf).select(
        "run_id", "attempt", "mode", "verdict", "max_retries")
    # Hashing by attempt scatters each run over the files: arrival is out of order.
    rows.repartition(parts, "run_id", "attempt").write.parquet(f"{base}/attempts")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch) \
        .parquet(f"{base}/attempts")
    fold_stream(stream, f"{base}/runs", f"{base}/checkpoint").awaitTermination()
    return latest_runs(spark, f"{base}/runs")


QUERIES = {
    "f_append_stream": append_stream,
    "f_append_stream_repos": append_stream_repos,
    "f_append_stream_twice": append_stream_twice,
    "l_fold_run_stream": fold_run_stream,
}

ORACLES = {
    "f_append_stream": f"""WITH {v.SQL_V3}
SELECT node_id, node_type, rel_path AS file_path, symbol_name, source_code, language FROM v3_ids""",
    "f_append_stream_repos": f"""WITH {v.SQL_V3}
SELECT r.repo, language, count(*) AS n_nodes, count(DISTINCT node_id) AS n_ids, count(DISTINCT rel_path) AS n_files
FROM v3_ids, (VALUES ('east'), ('west')) r(repo) GROUP BY r.repo, language""",
    "f_append_stream_twice": f"""WITH {v.SQL_V3},
symbols AS (SELECT node_id, symbol_name, node_type, rel_path AS file_path FROM v3_ids), {v.SQL_V5}, {v.SQL_V5_HITS}
SELECT qid, pos, node_id, symbol_name, file_path FROM hits JOIN symbols USING (node_id)""",
    "l_fold_run_stream": run_queries.FOLD_SQL,
}
