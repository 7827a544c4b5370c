"""Brown class-based n-gram scores of whole texts.

Texts become chunks: a slice's distinct words, counted, and its texts as codes
of these words. Counts of all words over all chunks come from one aggregation,
however large the vocabulary; each chunk then gets back the counts of its own
words only, and only where they differ from its local ones. So no task holds a
vocabulary, and nothing but the class model and a filter, whose sizes are
fixed, is sent to all tasks.

Classes come from exchange clustering, in two steps. First of units: each of
the TOP_WORDS most frequent words is one, other words are pooled by their
endings, and the text's end is a class of its own. Units move to the class that
raises the likelihood of the training text's class bigrams most, until no move
helps. Then of every other word that training holds LEAST times or more,
however many there are: the classes beside its occurrences are counted, and it
leaves its pool for the class that raises the likelihood most. Only rarer and
unknown words have the class of their ending's pool. Chunks are told the
classes of their words with the counts, and the transitions are counted from
the classes of all words. A token's probability mixes class transition times
word emission with the smoothed frequency of the word:

    p(w | before) = MIX * p(class | class before) * (c + 1) / (tokens + types + 1 of the class)
                  + (1 - MIX) * (c + 1) / (N + V + 1)

Each factor sums to 1 with one place for all unknown words, so scores of texts
are comparable with the base score, which is the second factor alone.

Defined results: a null or empty text is its end token alone; a very long text
is a chunk of its own and scored whole; words are bytes, so those that are not
UTF-8 are words like others; repeated rows
and equal keys count and are scored row by row; null keys stay null; without
training rows every count is 0; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from symgrove.llm.tables import stored
from symgrove.llm.words import binary_array, coded_words, text_slices

TOP_WORDS = 1000
ENDINGS = 400
ENDING_BYTES = 3
# Training count from which a word is clustered itself.
LEAST = 20
CLASSES = 48
ROUNDS = 8
MIX = 0.85
SMOOTHING = 1.0
# The end of a text, as a word: no word holds white space.
END = b"\n"
# Numbers of 64 bits in the filter of words to be clustered.
FILTER = 1 << 16

CHUNK = ("chunk long, keys array<long>, train array<boolean>, first array<int>, words array<binary>, "
         "pools array<short>, n_train array<long>, codes binary")
TOLD = "chunk long, keys array<long>, train array<boolean>, first array<int>, n array<long>, kinds binary, codes binary"


def _pack(codes: np.ndarray) -> bytes:
    """Codes as planes of bytes, which compress well: as many planes as the largest code needs, after their number."""
    planes = 3 if codes.max(initial=0) < 1 << 24 else 4
    return bytes([planes]) + np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    codes = planes[0].astype(np.int64)
    for i in range(1, len(planes)):
        codes |= planes[i].astype(np.int64) << 8 * i
    return codes


def chunked(docs: DataFrame, key: str, text: str, train) -> DataFrame:
    """One row per slice: its texts as codes, END after each, its distinct words and their training counts."""

    def chunk(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_slices(batch.column(1)):
                codes, words, first = coded_words(data, offsets)
                words = [END, *words.to_pylist()]
                codes = np.insert(codes.astype(np.int64) + 1, first[1:], 0)
                first = first + np.arange(len(first))
                trained = np.repeat(flags[low:high], np.diff(first))
                counts = np.bincount(codes[trained], minlength=len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) + n]), pa.array([batch.column(0).slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                    pa.array([flags[low:high].tolist()], pa.list_(pa.bool_())), pa.array([first.tolist()], pa.list_(pa.int32())),
                    pa.array([words], pa.list_(pa.binary())), pa.array([units_of(words, {})], pa.list_(pa.int16())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(codes)], pa.binary())],
                    names=["chunk", "keys", "train", "first", "words", "pools", "n_train", "codes"])
                n += 1

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"),
                       train.alias("train")).mapInArrow(chunk, CHUNK)


def units_of(words: list[bytes], top: dict[bytes, int]) -> np.ndarray:
    """Unit of each word: 0 the end, then the top words, then pools by ending."""
    low = 1 + TOP_WORDS
    return np.fromiter((0 if w == END else top[w] if w in top else low + xxhash.xxh32_intdigest(w[-ENDING_BYTES:]) % ENDINGS
                        for w in words), dtype=np.int64, count=len(words))


UNITS = 1 + TOP_WORDS + ENDINGS


def unit_bigrams(chunks: DataFrame, top: dict[bytes, int]) -> np.ndarray:
    """Counts (before, unit) over all training texts; the text before the first word is the end. At most UNITS^2 pairs."""

    def count(batches):
        tally = np.zeros(UNITS * UNITS, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                units = units_of(row["words"], top)[_unpack(row["codes"])]
                first = np.array(row["first"])
                before = np.concatenate([[0], units[:-1]])       # an END stands before each text's first word
                trained = np.repeat(np.array(row["train"], dtype=bool), np.diff(first))
                pairs, n = np.unique((before * UNITS + units)[trained], return_counts=True)
                tally[pairs] += n
        pairs = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(tally[pairs])], names=["pair", "n"])

    counted = chunks.select("train", "first", "words", "codes").mapInArrow(count, "pair long, n long")
    found = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(UNITS * UNITS)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, self_: float) -> np.ndarray:
    """What joining each class adds to the likelihood: its row and its column grow, the corner by both and the self count."""
    some, other = np.flatnonzero(right), np.flatnonzero(left)
    rows, columns = table[:, some], table.T[:, other]
    gain = (_xlogx(rows + right[some]) - _xlogx(rows)).sum(axis=1) + (_xlogx(columns + left[other]) - _xlogx(columns)).sum(axis=1)
    corner = np.diag(table)
    gain += (_xlogx(corner + right + left + self_) - _xlogx(corner + right) - _xlogx(corner + left) + _xlogx(corner))
    sent, got = table.sum(axis=1), table.sum(axis=0)
    gain -= _xlogx(sent + right.sum() + self_) - _xlogx(sent) + _xlogx(got + left.sum() + self_) - _xlogx(got)
    gain[0] = -np.inf
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit by exchange clustering; unit 0 alone has class 0.

    Maximises sum N(a, b) log N(a, b) - sum N(a, .) log N(a, .) - sum N(., b) log N(., b).
    """
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight[1:], kind="stable") + 1
    of = np.zeros(n, dtype=np.int64)
    of[order] = np.minimum(1 + np.arange(n - 1), classes - 1)    # the most frequent alone, the others together
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            self_, right, left = bigrams[u, u], bigrams[u] @ member, bigrams[:, u] @ member
            was = of[u]
            right[was] -= self_
            left[was] -= self_
            table[was, :] -= right
            table[:, was] -= left
            table[was, was] -= self_
            gain = _gains(table, right, left, self_)
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            table[best, :] += right
            table[:, best] += left
            table[best, best] += self_
            member[u, was], member[u, best], of[u] = 0, 1, best
            moved += best != was
        if not moved:
            break
    return of


def likely_words(counts: DataFrame) -> np.ndarray:
    """Bits by crc32 of all words to be clustered; others may have their bits, then their contexts are counted in vain."""
    bits = counts.where(F.col("c") >= LEAST).select(F.crc32("word").alias("h")).groupBy(
        F.expr(f"(h >> 6) % {FILTER}").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).toArrow()
    likely = np.zeros(FILTER, np.int64)
    likely[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return likely.view(np.uint64)


# Of a word: classes before it, classes after it, itself after itself.
CELLS = 2 * CLASSES + 1


def word_contexts(chunks: DataFrame, top: dict[bytes, int], class_of: np.ndarray, likely: np.ndarray) -> DataFrame:
    """(word, cells, n) of each chunk's likely words other than top ones: cells of CELLS that have a count, and the counts."""

    def asked(word: bytes) -> bool:
        h = crc32(word)
        return bool(int(likely[(h >> 6) % FILTER]) >> (h & 63) & 1) and word not in top and word != END

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                words, codes = row["words"], _unpack(row["codes"])
                kinds = class_of[units_of(words, top)]
                trained = np.repeat(np.array(row["train"], dtype=bool), np.diff(row["first"]))
                wanted = np.fromiter((n > 0 and asked(w) for w, n in zip(words, row["n_train"])), dtype=bool, count=len(words))
                # An END stands before each text's first word and after its last.
                at = np.flatnonzero(wanted[codes] & trained)
                code, before, after = codes[at], np.where(at > 0, codes[at - 1], 0), codes[at + 1]
                left, right = kinds[before], np.where(after == code, 2 * CLASSES, CLASSES + kinds[after])
                cells = np.concatenate([(code * CELLS + left)[before != code], code * CELLS + right])
                cells, n = np.unique(cells, return_counts=True)
                found, begin = np.unique(cells // CELLS, return_index=True)
                bounds = np.append(begin, len(cells))
                yield pa.RecordBatch.from_arrays([
                    pa.array([words[c] for c in found.tolist()], pa.binary()),
                    binary_array((cells % CELLS).astype(np.uint8), bounds).cast(pa.binary()),
                    binary_array(n.astype("<u4").view(np.uint8), 4 * bounds).cast(pa.binary())], names=["word", "cells", "n"])

    return chunks.select("train", "first", "words", "n_train", "codes").mapInArrow(count, "word binary, cells binary, n binary")


def word_classes(contexts: DataFrame, class_of: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, class) of every word with LEAST training tokens: the class to which exchange moves it out of its pool's."""

    def judged(words: list[bytes], tally: np.ndarray):
        now, chosen = table.copy(), []
        kept = np.flatnonzero(tally[:, :CLASSES].sum(axis=1) + tally[:, -1] >= LEAST)
        words = [words[i] for i in kept.tolist()]
        for was, counts in zip(class_of[units_of(words, {})].tolist(), tally[kept]):
            left, right, self_ = counts[:CLASSES], counts[CLASSES:-1], counts[-1]
            now[was, :] -= right
            now[:, was] -= left
            now[was, was] -= self_
            gain = _gains(now, right, left, self_)
            best = int(gain.argmax())
            chosen.append(best if gain[best] > gain[was] + 1e-9 else was)
            now[was, :] += right
            now[:, was] += left
            now[was, was] += self_
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(chosen, pa.int32())], names=["word", "class"])

    def assign(batches):
        open_, held = None, np.zeros(CELLS)          # a word's rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            words, row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            parts = batch.column(1).to_pylist()
            row = np.repeat(row, [len(p) for p in parts])
            cells, n = np.frombuffer(b"".join(parts), np.uint8), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4")
            tally = np.bincount(row * CELLS + cells, weights=n, minlength=len(words) * CELLS).reshape(-1, CELLS)
            if open_ == words[0]:
                tally[0] += held
            elif open_ is not None:
                words, tally = [open_, *words], np.concatenate([held[None], tally])
            open_, held = words[-1], tally[-1]
            yield judged(words[:-1], tally[:-1])
        if open_ is not None:
            yield judged([open_], held[None])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word binary, class int")


def tell(chunks: DataFrame, known: DataFrame, class_of: np.ndarray) -> DataFrame:
    """Chunks with the counts and classes of their words in place of the words; known: (word, c, class), class null in a pool."""
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "n_train")).alias("code", "e")).select(
        "chunk", "code", F.col("e.words").alias("word"), F.col("e.n_train").alias("n"))
    # A chunk knows its own counts and pools; it is told what differs.
    told = (entries.join(known, "word").where("c != n OR class IS NOT NULL").groupBy("chunk")
            .agg(F.collect_list("code").alias("told"), F.collect_list("c").alias("c"),
                 F.collect_list(F.coalesce("class", F.lit(-1))).alias("class")))

    def put(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("pools", "n_train", "told", "c", "class")}
                n, kinds = (row[x].values.to_numpy(zero_copy_only=False) for x in ("n_train", "pools"))
                n, kinds = n.copy(), class_of[kinds]
                if row["told"].is_valid:
                    at, class_ = row["told"].values.to_numpy(), row["class"].values.to_numpy()
                    n[at] = row["c"].values.to_numpy()
                    kinds[at] = np.where(class_ < 0, kinds[at], class_)
                kept = [batch.column(x).slice(i, 1) for x in ("chunk", "keys", "train", "first", "codes")]
                yield pa.RecordBatch.from_arrays(
                    [*kept[:4], pa.array([n], pa.list_(pa.int64())), pa.array([kinds.astype(np.uint8).tobytes()], pa.binary()), kept[4]],
                    names=["chunk", "keys", "train", "first", "n", "kinds", "codes"])

    return chunks.drop("words").join(told, "chunk", "left").mapInArrow(put, TOLD)


def class_bigrams(told: DataFrame) -> np.ndarray:
    """Counts (class before, class) over all training texts."""

    def count(batches):
        tally = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                kinds = np.frombuffer(row["kinds"], np.uint8).astype(np.int64)[_unpack(row["codes"])]
                trained = np.repeat(np.array(row["train"], dtype=bool), np.diff(row["first"]))
                before = np.concatenate([[0], kinds[:-1]])
                tally += np.bincount((before * CLASSES + kinds)[trained], minlength=len(tally))
        pairs = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(tally[pairs])], names=["pair", "n"])

    found = told.select("train", "first", "kinds", "codes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES * CLASSES)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(CLASSES, CLASSES)


@dataclass
class Model:
    """Top words, class of each unit, log10 transitions, tokens and types of each class and of all, classes of words and told chunks."""

    top: dict[bytes, int]
    class_of: np.ndarray
    transition: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int
    known: DataFrame = field(repr=False)
    told: DataFrame = field(repr=False)


def fit(chunks: DataFrame, counts: DataFrame) -> Model:
    """chunks: of chunked(); counts: (word, c) of the training words."""
    # At most TOP_WORDS words are fetched.
    best = counts.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()
    top = {bytes(r["word"]): i + 1 for i, r in enumerate(best)}
    bigrams = unit_bigrams(chunks, top)
    class_of = exchange(bigrams)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), class_of] = 1
    table = member.T @ bigrams @ member
    contexts = word_contexts(chunks, top, class_of, likely_words(counts))
    classes = stored(word_classes(contexts, class_of, table), "word-classes")
    of_top = chunks.sparkSession.createDataFrame(
        [(bytearray(w), int(class_of[u])) for w, u in top.items()], "word binary, class int")
    known = counts.join(classes.union(of_top), "word", "left").select("word", "c", "class")
    told = stored(tell(chunks, known, class_of), "told-chunks")
    table = class_bigrams(told)
    share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
    transition = np.log10((table + SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + SMOOTHING))

    def tally(batches):
        tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            kinds = batch.column(2).fill_null(-1).to_numpy()
            kinds = np.where(kinds < 0, class_of[units_of(batch.column(0).to_pylist(), top)], kinds)
            tokens += np.bincount(kinds, weights=batch.column(1).to_numpy(), minlength=CLASSES).astype(np.int64)
            types += np.bincount(kinds, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(types)], names=["class", "tokens", "types"])

    rows = known.mapInArrow(tally, "class long, tokens long, types long").groupBy("class").agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        tokens[r["class"]], types[r["class"]] = r["tokens"], r["types"]
    return Model(top, class_of, transition, tokens, types, int(tokens.sum()), int(types.sum()), known, told)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, c) of all training words."""
    entries = chunks.select(F.explode(F.arrays_zip("words", "n_train")).alias("e")).select("e.words", "e.n_train").where("n_train > 0")
    return entries.groupBy(F.col("words").alias("word")).agg(F.sum("n_train").alias("c"))


def score(model: Model) -> DataFrame:
    """One row per text: key, train, n_tokens, n_known, base_score, score (log10)."""
    transition, class_tokens, class_types, everything = model.transition, model.class_tokens, model.class_types, model.tokens + model.types

    def judge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                count, kind = np.array(row["n"], dtype=np.int64), np.frombuffer(row["kinds"], np.uint8).astype(np.int64)
                codes, first = _unpack(row["codes"]), np.array(row["first"])
                base = np.log10((count + 1) / (everything + 1))
                emission = np.log10((count + 1) / (class_tokens[kind] + class_types[kind] + 1))
                kinds = kind[codes]
                before = np.concatenate([[0], kinds[:-1]])
                mixed = np.logaddexp((transition[before, kinds] + emission[codes]) * np.log(10) + np.log(MIX),
                                     base[codes] * np.log(10) + np.log(1 - MIX)) / np.log(10)
                sums = [np.add.reduceat(x, first[:-1]) for x in (base[codes], mixed, (count[codes] > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(np.diff(first)), pa.array(sums[2]),
                    pa.array(sums[0]), pa.array(sums[1])], names=["key", "train", "n_tokens", "n_known", "base_score", "score"])

    return model.told.mapInArrow(
        judge, "key long, train boolean, n_tokens long, n_known long, base_score double, score double")


def class_scores(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score and score of every row; train: condition of training rows."""
    chunks = stored(chunked(docs, key, text, train), "text-chunks")
    counts = stored(word_counts(chunks), "word-counts")
    model = fit(chunks, counts)
    return score(model).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
