"""files that arrive in a folder become stored, searchable nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from symgrove.operators.files import map_language, prune_dirs
from symgrove.operators.symbols import symbol_nodes
from symgrove.plans.manifest import writer_of
from symgrove.plans.storage import append_nodes, compact
from symgrove.schemas import FILES


def spread_files(files: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """files dealt over all cores: a batch is a few table files, which as many tasks would scan for symbols.

    The number is fixed: text shrinks so much on its way that its bytes would ask for one task.
    """
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, *key)


def ingest_stream(spark: SparkSession, drop_dir: str, nodes_path: str, checkpoint: str,
                  files_per_batch: int = 1000, key: tuple[str, ...] = ("repo", "rel_path"),
                  id_path: Column | None = None, compact_every: int = 32) -> StreamingQuery:
    """Append the symbols of every file table dropped so far, then stop.

    A batch is stored under the query's id, which its checkpoint keeps, and
    its own number: a replay after a failure replaces it, and any number of
    streams and other jobs may append to one table. Ids are scoped by
    repository unless ``id_path`` says otherwise. After ``compact_every``
    batches those that no replay can change are merged.
    """
    source = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch) \
        .parquet(drop_dir)

    def store(batch: DataFrame, batch_id: int) -> None:
        files = spread_files(map_language(prune_dirs(batch)), key)
        append_nodes(symbol_nodes(files, key, id_path=id_path), nodes_path, str(batch_id),
                     writer_of(batch, checkpoint))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(spark, nodes_path)

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
