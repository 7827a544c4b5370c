"""Words and byte strings of whole Arrow batches, without a loop over words.

A word is a run of characters other than space and ``\\t \\n \\v \\f \\r``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
# Texts of about this many bytes are worked on at a time; a longer text is a slice alone.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def fold(doc_key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo parts: which rows a model may learn from. Null keys: 0."""
    return F.coalesce(F.crc32(doc_key.cast("string").cast("binary")) % parts, F.lit(0))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of slices of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), len(texts), begin + SLICE_ROWS)
        yield begin, end, data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
        begin = end


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings over one buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice in order, and each row's first word (one more entry than rows)."""
    mask = _IS_WORD[data]
    edge = np.ones(len(data) + 1, dtype=bool)       # edge[i]: no word runs from byte i-1 into byte i
    if len(data):
        edge[1:-1] = ~mask[:-1] | ~mask[1:]
    edge[offsets] = True
    starts = np.flatnonzero(mask & edge[:-1])
    ends = np.flatnonzero(mask & edge[1:]) + 1
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    kept = data[mask]
    return binary_array(_LOWER[kept] if lower else kept, bounds), np.searchsorted(starts, offsets)


def coded_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes in order, the distinct words the codes point at, and each row's first word."""
    words, first = split_words(data, offsets, lower)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _FIRST
    h = (h ^ (h >> np.uint64(27))) * _SECOND
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles of width words, sorted by both.

    A row of fewer words, but one at least, has its whole sequence as only shingle.
    """
    codes, distinct, first = coded_words(data, offsets)
    hashed = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(len(codes) - width + 1, 0)
    rolled = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * _MULTIPLY + hashed[i:i + n]
    whole = row[:n] == row[width - 1:] if n else np.zeros(0, bool)
    rows, values = [row[:n][whole]], [mixed(rolled[whole])]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        one = np.uint64(counts[r])
        for h in hashed[first[r]:first[r + 1]]:
            one = np.uint64((int(one) * int(_MULTIPLY) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        rows.append(np.array([r]))
        values.append(mixed(np.array([one], dtype=np.uint64)))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]
