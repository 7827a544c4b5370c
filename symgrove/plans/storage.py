"""The stored node table (R1, R3) with its search index (S5): appended batch by batch, read as one.

A batch is written once, as ``nodes/folder=<f>``; its keys, postings and gram
counts are derived from that folder, and a commit publishes all of them
together. Keys lie in buckets of about KEYS_PER_BUCKET, one row per bucket
sorted by bucket, so a batch of m keys opens at most m such rows of each
folder, however many keys are stored. Compaction keeps the folders few.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from symgrove.operators import search
from symgrove.operators.nodes import STORED_COLUMNS, duplicate_keys, with_list_defaults
from symgrove.plans import manifest as m
from symgrove.schemas import CODE_NODES

PARTS = ("nodes", "keys", "index/postings", "index/grams")
KEYS_PER_BUCKET = 1 << 12
# Symbols whose postings one task makes and sorts: at least so many, up to eight tasks, and at most so many.
LEAST_PER_SALT, ROWS_PER_SALT = 1 << 15, 1 << 17
# Bucket numbers that are sent along as a pushed filter; a batch that hits more reads all keys.
LISTED_BUCKETS = 10_000
_STORED = T.StructType([
    *CODE_NODES.fields, T.StructField("repo", T.StringType()), T.StructField("n_len", T.LongType()),
    T.StructField("n_tok", T.LongType()), T.StructField("folder", T.StringType())])
_KEYS = "bucket bigint, node_ids array<string>, folder string"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("node_id"), F.lit(buckets))


def _write_keys(rows: DataFrame, path: str, folder: str, buckets: int) -> None:
    (rows.select("node_id", _bucket(buckets).alias("bucket")).groupBy("bucket")
     .agg(F.collect_list("node_id").alias("node_ids"))
     .repartitionByRange("bucket").sortWithinPartitions("bucket")
     .write.parquet(f"{path}/keys/folder={folder}"))


def stored_keys(rows: DataFrame, path: str, commits: Sequence[m.Commit]) -> DataFrame:
    """node_id of the stored keys that share a bucket with rows; only those buckets are read."""
    spark = rows.sparkSession
    most = max(c.facts["key_buckets"] for c in commits)
    # At most LISTED_BUCKETS + 1 numbers; bucket counts are powers of two, so one list serves all folders.
    hit = {r[0] for r in rows.select(_bucket(most)).distinct().limit(LISTED_BUCKETS + 1).collect()}
    found = None
    for buckets in sorted({c.facts["key_buckets"] for c in commits}):
        part = m.read_folders(spark, f"{path}/keys", [c for c in commits if c.facts["key_buckets"] == buckets], _KEYS)
        if len(hit) <= LISTED_BUCKETS:
            part = part.where(F.col("bucket").isin(sorted({h % buckets for h in hit})))
        part = part.select(F.explode("node_ids").alias("node_id"))
        found = part if found is None else found.unionByName(part)
    return found


def _checked(rows: DataFrame, path: str, commits: Sequence[m.Commit]) -> None:
    stored = stored_keys(rows, path, commits) if commits else None
    clashes = duplicate_keys(rows, stored).take(5)
    if clashes:
        raise ValueError(f"duplicate node_id: {[row['node_id'] for row in clashes]}")


def _derive(rows: DataFrame, path: str, folder: str, facts: dict[str, int]) -> dict[str, int]:
    """Keys and index of a written folder; its facts."""
    buckets = 1
    while buckets * KEYS_PER_BUCKET < facts["rows"]:
        buckets *= 2
    _write_keys(rows, path, folder, buckets)
    # No more salts than cores or memory ask for, as each makes a file per bucket.
    salts = max(min(8, 1 + facts["rows"] // LEAST_PER_SALT), 1 + facts["rows"] // ROWS_PER_SALT)
    search.write_index(search.symbol_docs(rows), f"{path}/index", folder, salts)
    return {**facts, "key_buckets": buckets}


def _facts(rows: DataFrame) -> dict[str, int]:
    docs = search.symbol_docs(rows)
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"rows": n, "sum_dl": total}


def append_nodes(nodes: DataFrame, path: str, batch_id: str | None = None, writer: str = m.ONCE,
                 folder: str | None = None) -> bool:
    """Append a batch to the node table and its index together; False if it is empty.

    A duplicate key, in the batch or stored, raises before anything is
    published. ``writer`` and ``batch_id`` name the batch: the same ones again
    replace it, other writers' batches of the same number are left alone.
    """
    spark, folder = nodes.sparkSession, folder or m.new_folder()
    batch_id = batch_id or uuid.uuid4().hex
    table = m.Manifest(spark, path)
    if table.settled(writer, batch_id):
        return True
    with_list_defaults(nodes, STORED_COLUMNS).write.partitionBy("language").parquet(f"{path}/nodes/folder={folder}")
    rows = _read(spark, path, [m.Commit(writer, batch_id, 0, folder)])
    facts = _facts(rows)
    if not facts["rows"]:
        if (writer, batch_id) in table.latest:      # a replay that has become empty
            table.publish(writer, batch_id, folder, {**facts, "key_buckets": 1})
        return False
    _checked(rows, path, table.others(writer, batch_id))
    facts = _derive(rows, path, folder, facts)
    table.publish(writer, batch_id, folder, facts)
    return True


def _read(spark: SparkSession, path: str, commits: Sequence[m.Commit]) -> DataFrame:
    full = [c for c in commits if c.facts.get("rows", 1)]
    return m.read_folders(spark, f"{path}/nodes", full, _STORED).drop("folder")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All published nodes; none before the first batch. Pruned by language when filtered on it."""
    return with_list_defaults(_read(spark, path, m.Manifest(spark, path).live), STORED_COLUMNS)


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, search.Index]:
    """Nodes and index of the same commits."""
    live = [c for c in m.Manifest(spark, path).live if c.facts["rows"]]
    nodes = with_list_defaults(_read(spark, path, live), STORED_COLUMNS)
    return nodes, search.read_index(spark, f"{path}/index", live)


def compact(spark: SparkSession, path: str, least: int = 2) -> bool:
    """Merge folders of closed batches into one, if ``least`` are worth it; readers see either state."""
    table = m.Manifest(spark, path)
    closed = table.compactable(least)
    if not closed:
        return False
    folder, full = m.new_folder(), [c for c in closed if c.facts["rows"]]
    facts = {"rows": sum(c.facts["rows"] for c in full), "sum_dl": sum(c.facts["sum_dl"] for c in full), "key_buckets": 1}
    if full:
        _read(spark, path, full).select(*STORED_COLUMNS).write.partitionBy("language").parquet(
            f"{path}/nodes/folder={folder}")
        rows = _read(spark, path, [m.Commit(m.COMPACTION, "", 0, folder)])
        facts = _derive(rows, path, folder, facts)
    table.publish(m.COMPACTION, folder, folder, facts, [c.folder for c in closed])
    return True
