"""Packing by concatenate and cut.

Pass one encodes every document once, where its file split is read, and stores
its ids with the task's number and the ids before them in that task. The
tasks' totals, one number each, get prefix sums; added to the stored starts
they place every id in one global stream. Pass two cuts the stream at
multiples of the sequence length: a document becomes one boundary record per
window that it touches. Nothing is sorted and no text is shuffled.

Defined results: a null or empty text is its end mark alone; bytes that are
not UTF-8 are read as U+FFFD; a text of any length is stored in blocks of BLOCK ids, each cut on its own; repeated rows
and equal keys are packed once per row; null keys stay null; other columns of
the input are not carried; an empty table gives no rows. Only the last
sequence is shorter than the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from symgrove.llm.bpe import encoded
from symgrove.llm.tables import stored

SEQUENCE = 2048
BLOCK = 1 << 14


def token_blocks(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every row: task, begin (the task's ids before), key, start (the row's ids before), doc_tokens, ids.

    ``ids`` holds at most BLOCK little-endian unsigned 32-bit numbers.
    """
    schema = StructType([
        StructField("task", IntegerType()), StructField("begin", LongType()),
        StructField("key", docs.schema[key].dataType), StructField("start", LongType()),
        StructField("doc_tokens", LongType()), StructField("n_ids", LongType()), StructField("ids", BinaryType())])
    key_type = None

    def encode(batches):
        nonlocal key_type
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, key_type = batch.column(0), batch.column(0).type
            for low, high, ids, ends in encoded(batch.column(1), tokenizer, end_id):
                sizes = np.diff(ends)
                blocks = -(-sizes // BLOCK)
                row = np.repeat(np.arange(high - low), blocks)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
                begin = ends[:-1][row] + start
                data, edges = ids.astype("<u4", copy=False), np.append(begin, len(ids)).astype(np.int64) * 4
                for part in range(0, len(row), 4096):
                    to = min(part + 4096, len(row))
                    base = edges[part]
                    binary = pa.Array.from_buffers(pa.binary(), to - part, [
                        None, pa.py_buffer((edges[part:to + 1] - base).astype(np.int32)),
                        pa.py_buffer(data[base // 4:edges[to] // 4])])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(to - part, task, np.int32)), pa.array(before + begin[part:to]),
                        keys.take(pa.array(low + row[part:to])), pa.array(start[part:to]),
                        pa.array(sizes[row[part:to]]), pa.array(np.diff(edges[part:to + 1]) // 4), binary],
                        names=schema.names)
                before += len(ids)

    return docs.select(F.col(key).alias("key"), F.make_valid_utf8(F.col(text).cast("string")).alias("text")).mapInArrow(encode, schema)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE,
         end_id: int = 1) -> DataFrame:
    """Pieces of all documents: key, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. Each
    id of the input stands in exactly one piece.
    """
    blocks = stored(token_blocks(docs, key, text, tokenizer, end_id), "token-blocks")
    totals = blocks.groupBy("task").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers per task of pass one: bounded by the number of file splits.
    offsets = totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    low = F.col("shift") + F.col("begin")
    windows = (blocks.join(F.broadcast(offsets), "task")
               .select("key", "start", "doc_tokens", "ids", "n_ids", low.alias("low"))
               .withColumn("window", F.explode(F.sequence(
                   F.floor(F.col("low") / length), F.floor((F.col("low") + F.col("n_ids") - 1) / length)))))
    begin = F.greatest("low", F.col("window") * length)
    end = F.least(F.col("low") + F.col("n_ids"), (F.col("window") + 1) * length)
    cut = windows.withColumns({"begin": begin, "end": end})
    return cut.select(
        F.col("key").alias(key),
        (F.col("start") + F.col("begin") - F.col("low")).alias("start"),
        (F.col("end") - F.col("begin")).alias("length"),
        F.col("ids").substr(((F.col("begin") - F.col("low")) * 4 + 1).cast("int"),
                            ((F.col("end") - F.col("begin")) * 4).cast("int")).alias("ids"),
        "doc_tokens",
        F.col("window").alias("sequence_id"),
        (F.col("begin") - F.col("window") * length).alias("offset"))


def sequences(pieces: DataFrame, key: str = "doc_id", length: int = SEQUENCE) -> DataFrame:
    """Whole sequences: sequence_id, ids, n_ids, documents (keys in order). A group has at most length ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.struct(F.col(key).alias("key")).alias("doc"), "ids")))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids"))
            .select("sequence_id", F.concat(F.aggregate(
                "parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))).alias("ids"),
                "n_ids", F.transform("parts", lambda part: part["doc"]["key"]).alias("documents")))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(c) for c in pieces.columns])
