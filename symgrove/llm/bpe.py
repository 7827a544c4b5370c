"""Token ids of whole texts by a tokenizers file, each distinct piece encoded once.

A byte-level tokenizer first cuts a text into words, runs of digits, of marks
and of spaces; merges never cross such a cut. Some of these cuts show in the
bytes alone: before white space that follows a visible character, between an
ASCII word character and a mark, after a lone line end. The text's ids are
then those of the pieces between such cuts, one after another, so a piece that
recurs is encoded once. Where the bytes leave a doubt (the character before
may be a space beyond ASCII, a special token stands in the slice) no cut is
made, which only leaves a longer piece. Files of other kinds are applied to
whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from symgrove.llm.words import binary_array, text_slices

SLICE_BYTES = 4 << 20
# Pieces that a worker remembers between slices, and the longest of them.
REMEMBERED = 250_000
REMEMBERED_BYTES = 24
# New pieces that are encoded as one text.
JOINED = 200

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ("09", "AZ", "az"):
    _ALNUM[ord(_low):ord(_high) + 1] = True
_MARK = _VISIBLE & ~_ALNUM
# Pieces that can stand side by side in one text and stay pieces of their own:
# no white space but one leading space.
_PLAIN = re.compile(rb" ?(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


class _Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.cuttable = (str(self.model.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
                         and "use_regex=True" in str(self.model.pre_tokenizer)
                         and self.model.normalizer is None
                         and not any(re.search(rb"\s", s) for s in self.special))
        vocabulary = self.model.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)                  # one character stands for one byte
        # Remembered pieces: their numbers, and the ids of piece n from bounds[n] to bounds[n + 1].
        self.number: dict[bytes, int] = {}
        self.bounds = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def whole(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        found = [e.ids for e in self.model.encode_batch_fast([p.decode() for p in pieces],
                                                             add_special_tokens=False)]
        return (np.array([i for one in found for i in one], dtype=np.uint32),
                np.fromiter(map(len, found), dtype=np.int64, count=len(found)))

    def joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), for plain pieces: many encoded as one text, told apart by their bytes."""
        between = b"" if pieces[0].startswith(b" ") else b"\n"
        ids, _ = self.whole([between.join(pieces[low:low + JOINED]) + between
                             for low in range(0, len(pieces), JOINED)])
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + len(between)
        ends = np.cumsum(sizes)
        reached = np.cumsum(self.bytes_of[ids])
        upto = np.searchsorted(reached, ends) + 1           # ids up to the end of each piece
        lengths = np.diff(upto, prepend=0)
        if between:
            ids, lengths = np.delete(ids, upto - 1), lengths - 1
        return ids, lengths

    def pieces(self, distinct: list[bytes], special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each piece, bounds, ids): remembered pieces, then those met for the first time."""
        number = self.number
        numbers = [number.get(p, -1) for p in distinct]
        kinds: tuple[list, list, list] = ([], [], [])       # places in distinct
        plain = _PLAIN.fullmatch if self.cuttable and not special else lambda piece: None
        for i, n in enumerate(numbers):
            if n < 0:
                kinds[(1 if distinct[i][0] == 0x20 else 2) if plain(distinct[i]) else 0].append(i)
        numbers, flats, lengths, new = np.array(numbers, dtype=np.int64), [self.flat], [], len(self.bounds) - 1
        for places, method in zip(kinds, (self.whole, self.joined, self.joined)):
            if places:
                ids, sizes = method([distinct[i] for i in places])
                numbers[places] = np.arange(new, new + len(places))
                new += len(places)
                flats.append(ids)
                lengths.append(sizes)
        if not lengths:
            return numbers, self.bounds, self.flat
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(lengths))])
        flat = np.concatenate(flats)
        if len(number) < REMEMBERED:
            number.update((distinct[i], int(numbers[i])) for places in kinds for i in places
                          if len(distinct[i]) <= REMEMBERED_BYTES)
            self.bounds, self.flat = bounds, flat
        return numbers, bounds, flat


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    """One per worker and file."""
    return _Encoder(path)


def cuts(data: np.ndarray, offsets: np.ndarray, coder: _Encoder, special: bool) -> np.ndarray:
    """Where pieces begin, rows' beginnings among them, and the end."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    if coder.cuttable and len(data) > 3:
        space, visible = _SPACE[data], _VISIBLE[data]
        known = visible.copy()                              # ends a character that is no white space
        known[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        cut[1:-1] |= space[1:] & known[:-1]
        if not special:
            word, mark = _ALNUM[data], _MARK[data]
            word[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:-1] |= mark[1:] & word[:-1]
            cut[2:-1] |= (data[1:-1] == 0x0A) & known[:-2] & (visible[2:] | (data[2:] >= 0xC3) & (data[2:] <= 0xDF))
    return np.flatnonzero(cut)


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, row offsets into them); each row's ids end with end_id."""
    coder = encoder(path)
    for begin, end, data, offsets in text_slices(texts, SLICE_BYTES):
        special = any(s in data.tobytes() for s in coder.special)
        where = cuts(data, offsets, coder, special)
        coded = binary_array(data, where).dictionary_encode()
        numbers, bounds, flat = coder.pieces(coded.dictionary.to_pylist(), special)
        # A row is its pieces and one end mark, which is the last of the lists.
        lists = pa.LargeListArray.from_arrays(np.append(bounds, bounds[-1] + 1),
                                              np.append(flat[:bounds[-1]], np.uint32(end_id)))
        first = np.searchsorted(where[:-1], offsets)
        steps = np.insert(numbers[coded.indices.to_numpy(zero_copy_only=False)], first[1:], len(bounds) - 1)
        taken = lists.take(pa.array(steps))
        marks = first[1:] + np.arange(end - begin)          # the end marks among the pieces
        ends = taken.offsets.to_numpy()[marks + 1]
        yield begin, end, taken.values.to_numpy(), np.concatenate([[0], ends])
