"""File-tree source: distributed listing and reading.

Directories are listed level by level as Spark jobs, so one huge repository is
spread over all tasks. Each level is written to the shared folder before the
next is read. Spark's own file sources hide names that start with ``_`` or
``.``; this listing keeps them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.operators.files import map_language, searched_dirs
from symgrove.plans.skew import byte_packed
from symgrove.schemas import SCANNED_FILES
from symgrove.session import scratch_path

_ENTRY = "repo string, root string, rel_path string, is_dir boolean, n_bytes bigint, list_error string"
_LIST_ROWS = 10_000
_READ_BYTES = 4 << 20
_READ = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("content", pa.binary()), ("read_error", pa.string())])


def local_path(path: str) -> str:
    """A ``file:`` address as a plain path; other addresses stay as they are."""
    return re.sub(r"^file:(?://)?(?=/)", "", path)


def write_bytes(path: str, content: bytes) -> None:
    """Write one file, with the folders above it, to a mounted or remote path."""
    path = local_path(path)
    if "://" in path:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(base) as stream:
            stream.write(content)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as stream:
        stream.write(content)


def _children(root: str, rel_dir: str) -> Iterator[tuple[str, bool, int | None]]:
    """(name, is_dir, bytes) of one directory; links to directories are left out."""
    full = local_path(os.path.join(root, rel_dir) if rel_dir else root)
    if "://" in full:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(full)
        for info in system.get_file_info(fs.FileSelector(base)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size
        return
    with os.scandir(full) as entries:
        for entry in entries:
            if not entry.is_dir():
                try:
                    size = entry.stat().st_size
                except OSError:         # a link to nothing: reading it will say so
                    size = None
                yield entry.name, False, size
            elif not entry.is_symlink():
                yield entry.name, True, None


def _list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of directories; one that can't be listed is a row with the error in place of its entries."""
    columns = ["repo", "root", "rel_path", "is_dir", "n_bytes", "list_error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"n_bytes": "Int64"})

    for batch in batches:
        rows = []
        for repo, root, rel in zip(batch["repo"], batch["root"], batch["rel_path"]):
            try:
                for name, is_dir, size in _children(root, rel):
                    rows.append((repo, root, f"{rel}/{name}" if rel else name, is_dir, size, None))
                    if len(rows) >= _LIST_ROWS:
                        yield frame(rows)
                        rows = []
            except OSError as failure:
                rows.append((repo, root, rel, False, None, type(failure).__name__))
        if rows:
            yield frame(rows)


def _read_bytes(path: str) -> bytes:
    path = local_path(path)
    if "://" in path:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        with system.open_input_stream(base) as stream:
            return stream.read()
    with open(path, "rb") as stream:
        return stream.read()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    """rows as one batch; the list is emptied, so that a file is not held twice while the next ones are read."""
    columns = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(columns, _READ)], schema=_READ)
    rows.clear()
    return batch


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of the rows, sent on whenever _READ_BYTES are held, however many bytes a task reads."""
    for batch in batches:
        rows, held = [], 0
        for repo, root, rel in zip(*[batch.column(name).to_pylist() for name in ("repo", "root", "rel_path")]):
            try:
                content, error = _read_bytes(os.path.join(root, rel)), None
            except Exception as failure:  # noqa: BLE001 - any failure skips the file only
                content, error = None, type(failure).__name__
            rows.append((repo, rel, content, error))
            held += len(content or b"")
            if held >= _READ_BYTES:
                content, held = None, 0
                yield _sent(rows)
        if rows:
            yield _sent(rows)


def _spread(df: DataFrame) -> DataFrame:
    """Even tasks whatever the row sizes; rows here are paths only."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, "repo", "rel_path")


def list_entries(roots: DataFrame, prune: bool = True) -> DataFrame:
    """(repo, root, rel_path, n_bytes, list_error) of every file below the (repo, root) rows.

    A root or directory that cannot be listed is a row too, with its own path
    and ``list_error`` set.
    """
    spark = roots.sparkSession
    base = scratch_path(spark, "listing")
    level, depth = roots.select("repo", "root", F.lit("").alias("rel_path")), 0
    while True:
        _spread(level).mapInPandas(_list_dirs, _ENTRY).write.parquet(f"{base}/depth={depth}")
        found = spark.read.schema(_ENTRY).parquet(f"{base}/depth={depth}").where("is_dir")
        if prune:
            found = found.where(searched_dirs(F.slice(F.split("rel_path", "/"), -1, 1)))
        if found.isEmpty():
            break
        level, depth = found.select("repo", "root", "rel_path"), depth + 1
    return spark.read.schema(_ENTRY).parquet(*[f"{base}/depth={d}" for d in range(depth + 1)]) \
        .where(~F.col("is_dir")).drop("is_dir")


def list_tree(roots: DataFrame, prune: bool = True) -> DataFrame:
    """(repo, root, rel_path, n_bytes) of every file below the (repo, root) rows."""
    return list_entries(roots, prune).where("list_error IS NULL").drop("list_error")


def read_files(manifest: DataFrame) -> DataFrame:
    """bytes of the files named by (repo, root, rel_path).

    A file that cannot be read keeps its row, with ``read_error`` set. With
    ``n_bytes`` given, tasks read about equal numbers of bytes.
    """
    size = F.col("n_bytes") if "n_bytes" in manifest.columns else F.lit(None).cast("bigint")
    files = manifest.select("repo", "root", "rel_path", size.alias("n_bytes"))
    return byte_packed(files, "n_bytes", ["repo", "rel_path"]).drop("n_bytes") \
        .mapInArrow(_read_rows, SCANNED_FILES)


def scan_files(roots: DataFrame) -> DataFrame:
    """one row per supported source file below each root, with its bytes.

    Pruning and the extension filter run on paths, before any byte is read.
    What could not be listed is a row without language, with ``read_error``.
    """
    entries = list_entries(roots)
    read = read_files(map_language(entries.where("list_error IS NULL")).drop("language", "list_error"))
    unlisted = entries.where("list_error IS NOT NULL").select(
        "repo", "rel_path", F.lit(None).cast("binary").alias("content"), F.col("list_error").alias("read_error"),
        F.lit(None).cast("string").alias("language"))
    return map_language(read).unionByName(unlisted)


def files_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored (repo, rel_path, content) table as input files."""
    return spark.read.format(fmt).option("ignoreCorruptFiles", "true") \
        .option("ignoreMissingFiles", "true").load(path).select("repo", "rel_path", "content")
