"""End-to-end jobs: trees to stored symbols, queries to context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symgrove.constants import MAX_TOKENS, SEARCH_LIMIT
from symgrove.operators import context as g
from symgrove.operators.files import split_readable
from symgrove.operators.search import search_symbols
from symgrove.operators.symbols import symbol_nodes
from symgrove.plans.manifest import new_folder
from symgrove.plans.storage import append_nodes, read_nodes, read_table
from symgrove.session import scratch_path
from symgrove.sources.tree import scan_files


def ingest_trees(roots: DataFrame, path: str, extended: bool = False,
                 batch_id: str | None = None, id_path: Column | None = None) -> DataFrame:
    """Scan (repo, root) trees, store their symbols under path and index them.

    Ids are scoped by repository, however many there are, so repositories may
    come together, one after another or as a stream and keep their ids. Files
    that could not be read are rows of ``path/unreadable``, with the error.
    Returns the stored nodes; a table without symbols is empty and searchable.
    """
    spark, folder = roots.sparkSession, new_folder()
    staged = scratch_path(spark, "scanned-files")
    scanned = scan_files(roots)
    scanned.write.parquet(staged)                   # every byte is read once
    files, unreadable = split_readable(spark.read.schema(scanned.schema).parquet(staged))
    unreadable.write.parquet(f"{path}/unreadable/folder={folder}")
    append_nodes(symbol_nodes(files, ("repo", "rel_path"), extended, id_path), path, batch_id, folder=folder)
    return read_nodes(spark, path)


def search_stored(spark: SparkSession, path: str, queries: DataFrame,
                  k: int = SEARCH_LIMIT) -> DataFrame:
    """Search the symbols stored under path by their index; nodes and index are of the same commits."""
    nodes, index = read_table(spark, path)
    return search_symbols(queries, nodes, k, index)


def context_of_best_hits(hits: DataFrame, nodes: DataFrame, edges: DataFrame,
                         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Budgeted context, with source text, of each query's best hit."""
    best = hits.where("pos = 1").select("qid", F.col("node_id").alias("target_id"))
    sizes = g.count_tokens(nodes)
    radius = g.blast_radius(g.limit_neighbours(edges, targets=best), sizes)
    kept = g.attach_source(g.prune_context(radius, sizes, max_tokens, best), nodes)
    return best.join(kept, "target_id")
