"""Token files: Arrow files of fixed-size lists, with a file of document bounds beside each.

Rows are dealt to files by ranges of key and text, so that files in the order
of their names hold documents in ascending key order (null keys first). A task
sorts its rows, encodes them once and streams them into ``tokens-N.arrow``:
batches with the columns ``ids`` (fixed-size lists of unsigned integers) and
``mask`` (fixed-size lists of bits; unset ones mark filling after the file's
last id). All sequences of all files have one length, so sequence i of a file is
found by arithmetic, and a mapped file gives ids and masks without a copy.
``documents-N.arrow`` says where each document lies; the id that ends a
document may also stand inside a text, so it can't tell.

A task writes under a name of its own attempt and renames it, so a repeated or
doubled task leaves one whole file. Paths may be of any file system that Arrow
opens.

Defined results: a null or empty text is its end mark alone; a text longer
than a sequence runs on in the next ones; rows with equal keys follow each
other, ordered by their first characters and a hash of the text, and may fill
several files; bytes that are not UTF-8 are read as U+FFFD; other columns are
not written; an empty table gives a table of files without rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from symgrove.llm.bpe import encoded, encoder
from symgrove.llm.tables import stored

SEQUENCE = 2048
# Sequences in one record batch, and bytes of text that one file is to hold.
BATCH = 512
FILE_BYTES = 32 << 20
# Characters of a text that order rows of one key.
HEAD = 32

FILES = StructType([StructField("part", IntegerType()), StructField("tokens", StringType()),
                    StructField("documents", StringType()), StructField("n_ids", LongType()),
                    StructField("n_sequences", LongType()), StructField("n_documents", LongType())])


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Writer:
    """One file of equal-length sequences; holds less than a batch of ids at a time."""

    def __init__(self, system, path: str, length: int, id_type: pa.DataType):
        self.length, self.type = length, id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = system.open_output_stream(path)
        self.file = ipc.new_file(self.stream, self.schema)
        self.waiting, self.held, self.total, self.rows = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * BATCH
        if self.held >= full:
            ids = np.concatenate(self.waiting)
            for low in range(0, self.held - full + 1, full):
                self._write(ids[low:low + full], full)
            rest = self.held % full
            self.waiting, self.held = [ids[len(ids) - rest:].copy()], rest

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length)
                  for x, t in ((ids, self.type), (mask, pa.bool_()))]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.rows += len(ids) // self.length

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            filled = np.zeros(-(-len(ids) // self.length) * self.length, ids.dtype)
            filled[:len(ids)] = ids
            self._write(filled, len(ids))
        self.file.close()
        self.stream.close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                      length: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Write all documents under path; returns the table of files, one row each (see FILES)."""
    source = docs.select(F.col(key).alias("key"), F.make_valid_utf8(F.col(text).cast("string")).alias("text")).withColumns({
        "head": F.left("text", F.lit(HEAD)), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    held = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-int(held) // FILE_BYTES))

    def write(batches):
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        id_type = pa.uint16() if len(encoder(tokenizer).bytes_of) <= 1 << 16 else pa.uint32()
        writer = index = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                system, root = _open(path)
                names = [f"{root}/{kind}-{part:06d}.arrow" for kind in ("tokens", "documents")]
                drafts = [f"{name}.{attempt}" for name in names]
                writer = _Writer(system, drafts[0], length, id_type)
                index_stream = system.open_output_stream(drafts[1])
                index = ipc.new_file(index_stream, pa.schema([
                    ("key", batch.column(0).type), ("start", pa.int64()), ("n_ids", pa.int64())]))
                n_docs = 0
            for low, high, ids, ends in encoded(batch.column(1), tokenizer, end_id):
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(writer.total + ends[:-1]),
                     pa.array(np.diff(ends))], names=["key", "start", "n_ids"]))
                writer.add(ids.astype(id_type.to_pandas_dtype()))
                n_docs += high - low
        if writer is not None:
            writer.close()
            index.close()
            index_stream.close()
            for draft, name in zip(drafts, names):
                if system.get_file_info(name).type != fs.FileType.NotFound:      # of an attempt that was lost later
                    system.delete_file(name)
                system.move(draft, name)
            yield pa.RecordBatch.from_pylist([{
                "part": part, "tokens": names[0].rsplit("/", 1)[1], "documents": names[1].rsplit("/", 1)[1],
                "n_ids": writer.total, "n_sequences": writer.rows, "n_documents": n_docs}],
                schema=pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("documents", pa.string()),
                                  ("n_ids", pa.int64()), ("n_sequences", pa.int64()), ("n_documents", pa.int64())]))

    system, root = _open(path)
    system.create_dir(root, recursive=True)
    # Many rows of one key, even of one text, still fall into several files.
    order = [F.col(c).asc_nulls_first() for c in ("key", "head", "hash", "row")]
    ordered = source.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")
    return stored(ordered.mapInArrow(write, FILES), "token-file-table")


class TokenFile:
    """Random access to one file: sequence i as views of the mapped bytes."""

    def __init__(self, path: str):
        system, place = _open(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = ipc.open_file(pa.memory_map(place) if local else system.open_input_file(place))
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of batch i, flat."""
        batch = self.reader.get_batch(i)
        return batch.column(0).flatten().to_numpy(), batch.column(1).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = self.batch(i // BATCH)
        low = i % BATCH * self.length
        return ids[low:low + self.length], mask.slice(low, self.length)

    def ids(self, start: int, count: int):
        """Ids start to start + count of the file's stream, as one array per batch that holds some."""
        full = self.length * BATCH
        while count > 0:
            found = self.batch(start // full)[0][start % full:start % full + count]
            yield found
            start, count = start + len(found), count - len(found)


def read_token_files(spark: SparkSession, path: str, files: DataFrame, key_type) -> DataFrame:
    """Documents read back from the files: key, start (ids before it in all files), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit numbers in blocks' order: array of binary.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file; the window orders the table of files, not the tokens.
    placed = files.select("part", "tokens", "documents", F.coalesce(
        F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    schema = StructType([StructField("key", key_type), StructField("start", LongType()),
                         StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(f"{path}/{row['tokens']}")
                system, place = _open(f"{path}/{row['documents']}")
                with system.open_input_file(place) as source:
                    index = ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        bounds = index.get_batch(i)
                        starts, counts = (bounds.column(c).to_numpy() for c in (1, 2))
                        low = 0
                        while low < len(counts):        # about 4 million ids at a time
                            high = low + max(1, int(np.searchsorted(np.cumsum(counts[low:]), 1 << 22)))
                            sizes = counts[low:high]
                            ids = np.concatenate(list(tokens.ids(int(starts[low]), int(sizes.sum())))).astype("<u4")
                            edges = np.concatenate([[0], np.cumsum(sizes)]) * 4
                            yield pa.RecordBatch.from_arrays([
                                bounds.column(0).slice(low, high - low), pa.array(row["before"] + starts[low:high]),
                                pa.array(sizes), pa.Array.from_buffers(pa.binary(), high - low, [
                                    None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])],
                                names=schema.names)
                            low = high

    # Each file in a task of its own, however small the table of files is.
    n = max(1, files.count())
    return placed.repartition(n, "part").mapInArrow(read, schema)
