"""Token counts of whole texts, each distinct pre-token counted once.

Texts are cut into pre-tokens: runs of characters between cuts that the
tokenizer makes whatever surrounds them (``bpe``). A document's count is the
sum over its pre-tokens of frequency times tokens of the pre-token. The most
frequent pre-tokens of a bounded sample are counted first and sent to all
tasks; their frequencies are summed where the text is read. All others leave
as (row, pre-token, frequency), one row each; their distinct pre-tokens are
counted once, joined to the frequencies and summed per row. Which way a
pre-token goes changes no result. Ids of a document are never built.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any
length is counted whole, and a pre-token beyond LONGEST bytes (a text without
cuts) is counted where it stands instead of travelling; bytes that are not
UTF-8 are replaced by U+FFFD, one for each run that cannot be read, and then
counted; strings of special tokens count as the library takes them by
default. Repeated rows and equal or null keys stay rows of their own; other
columns are not carried, whatever their names; an empty table gives no rows.
Files whose cuts are not known count whole texts as single pre-tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from symgrove.llm import bpe
from symgrove.llm.tables import stored
from symgrove.llm.words import binary_array, text_slices

# Rows that the frequent pre-tokens are taken from, how many of them, and their greatest size.
SAMPLE_ROWS = 20_000
FREQUENT = 1 << 18
FREQUENT_BYTES = 24
LONGEST = 1 << 10
SLICE_BYTES = 8 << 20
# Pre-tokens encoded at a time.
COUNTED = 1 << 14


class _Bpe:
    """Pre-tokens and their sizes by a tokenizers file."""

    def __init__(self, path: str):
        self.coder = bpe.encoder(path)

    def special(self, data: bytes) -> bool:
        return any(s in data for s in self.coder.special)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return bpe.cuts(data, offsets, self.coder, self.special(data.tobytes()))

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        numbers, bounds, _ = self.coder.pieces(pieces, self.special(b"\n".join(pieces)))
        return np.diff(bounds)[numbers]


class _Sentences:
    """The same by a sentencepiece file. Texts are whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.unique(offsets)

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        ids = self.model.encode([p.decode() for p in pieces], num_threads=1)
        return np.fromiter(map(len, ids), dtype=np.int64, count=len(pieces))


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> _Bpe | _Sentences:
    return (_Sentences if path.endswith(".model") else _Bpe)(path)


def _slices(texts: pa.Array, counter) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, end row, codes of pre-tokens in order, first code of each row, distinct pre-tokens)."""
    for low, high, data, offsets in text_slices(texts, SLICE_BYTES):
        where = counter.cuts(data, offsets)
        coded = binary_array(data, where).dictionary_encode()
        yield (low, high, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(where[:-1], offsets),
               coded.dictionary)


def _sizes(pieces: pa.Array, path: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[
        _counter(path).sizes(pieces[i:i + COUNTED].to_pylist()) for i in range(0, len(pieces), COUNTED)]])


def _counted(pieces: DataFrame, path: str) -> DataFrame:
    """piece and its tokens, n."""
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sizes(batch.column(0), path))],
                                             names=["piece", "n"])

    return pieces.mapInArrow(count, "piece binary, n bigint")


def _frequent(texts: DataFrame, path: str) -> pa.Table:
    """The most frequent pre-tokens of a sample and their tokens."""
    rows = texts.count()
    if rows > SAMPLE_ROWS:
        texts = texts.sample(fraction=SAMPLE_ROWS / rows, seed=7)

    def seen(batches):
        counter = _counter(path)
        for batch in batches:
            for *_, codes, _, distinct in _slices(batch.column(0), counter):
                short = pc.less_equal(pc.binary_length(distinct), FREQUENT_BYTES)
                times = pa.array(np.bincount(codes, minlength=len(distinct)))
                yield pa.RecordBatch.from_arrays(
                    [distinct.filter(short).cast(pa.binary()), times.filter(short)], names=["piece", "times"])

    top = (texts.mapInArrow(seen, "piece binary, times bigint").groupBy("piece").agg(F.sum("times").alias("times"))
           .orderBy(F.desc("times"), "piece").limit(FREQUENT).select("piece"))
    return _counted(top.repartition(64), path).toArrow()


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.make_valid_utf8(F.col(text).cast("string")).alias("text"))
    known = _frequent(texts.select("text"), path).combine_chunks()
    # At most FREQUENT entries of FREQUENT_BYTES.
    shared = spark.sparkContext.broadcast((known["piece"].to_pylist(), known["n"].to_pylist()))
    schema = StructType([
        StructField("row", LongType()), StructField("key", docs.schema[key].dataType),
        StructField("n_bytes", LongType()), StructField("here", LongType()),
        StructField("piece", BinaryType()), StructField("times", LongType())])

    def split(batches):
        counter, task = _counter(path), TaskContext.get().partitionId() << 33
        pieces, sizes = shared.value
        pieces, sizes = pa.array(pieces, pa.large_binary()), np.append(np.array(sizes, np.int64), 0)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for low, high, codes, first, distinct in _slices(batch.column(1), counter):
                rows = high - low
                place = pc.fill_null(pc.index_in(distinct, value_set=pieces), len(pieces)).to_numpy()
                each = sizes[place]
                rare = place == len(pieces)
                long = np.flatnonzero(rare & (pc.binary_length(distinct).to_numpy() > LONGEST))
                each[long] = _sizes(distinct.take(pa.array(long)), path)
                rare[long] = False
                upto = np.concatenate([[0], np.cumsum(each[codes])])
                here = np.diff(upto[first])
                numbers = task + np.arange(rows)
                task += rows
                nothing = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(numbers), batch.column(0).slice(low, rows), pa.array(lengths[low:high].astype(np.int64)),
                    pa.array(here), nothing, pa.nulls(rows, pa.int64())], names=schema.names)
                of_row = np.repeat(np.arange(rows), np.diff(first))
                apart = rare[codes]
                pairs, times = np.unique(of_row[apart] * len(distinct) + codes[apart], return_counts=True)
                for i in range(0, len(pairs), 1 << 16):
                    part = pairs[i:i + (1 << 16)]
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(numbers[part // len(distinct)]), pa.nulls(len(part), batch.column(0).type), none, none,
                        distinct.take(pa.array(part % len(distinct))).cast(pa.binary()),
                        pa.array(times[i:i + (1 << 16)])], names=schema.names)

    cut = stored(texts.mapInArrow(split, schema), "pre-tokens")
    frequencies = cut.where("piece IS NOT NULL").select("row", "piece", "times")
    tokens = _counted(frequencies.select("piece").distinct(), path)
    elsewhere = (frequencies.join(tokens, "piece").groupBy("row")
                 .agg(F.sum(F.col("times") * F.col("n")).alias("elsewhere")))
    return cut.where("piece IS NULL").join(elsewhere, "row", "left").select(
        F.col("key").alias(key), "n_bytes",
        (F.col("here") + F.coalesce("elsewhere", F.lit(0))).alias("n_tokens"))
