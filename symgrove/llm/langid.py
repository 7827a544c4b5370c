"""Language identification by words first, character n-grams where a word is unknown.

From a bounded sample of labelled rows come counts of words by language, and
of the character n-grams of their distinct words, with bounds of the word. A
text's letters are cut into words; a known word adds its log frequency in each
language, an unknown one the mean log frequency of its n-grams of the greatest
length at which at least half of them are known: four characters, then three,
two and one. The language of the largest sum wins, and the score is its share
among all.

The sample holds of each language's distinct texts, chosen by hash, its share of
SAMPLE_ROWS or LANG_ROWS, whichever is more (all texts if it has fewer), so a
rare language is learned whatever the size of the others. Every word and
n-gram of the sample is known; its rows bound the model. Scoring is one pass
over whole texts. Each distinct word of a slice of texts is looked up once, all
of them together: known words and n-grams by one search in a table.

Defined results: a null text or one without a letter, and every text if
nothing was learned, is ``und`` with score 0; rows with a null language or a
null text teach nothing; texts of any length are judged whole, in slices of
several texts or alone; bytes that are not UTF-8 are no letters; ties go to the
language that sorts first; repeated rows count each; other columns are carried,
clashing ones replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from symgrove.llm.tables import stored
from symgrove.llm.words import coded_words, text_slices

SAMPLE_ROWS = 20_000
# Texts that a language has in the sample at least, about, if it has as many.
LANG_ROWS = 2_000
LENGTHS = (4, 3, 2, 1)
ALPHA = 0.1
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")
_LETTERS_OR_END = regex.compile(r"\p{L}+|\n")


def word_parts(word: bytes) -> list[str]:
    """Runs of letters, lower case."""
    return _LETTERS.findall(word.decode(errors="replace").lower())


def parts_of(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The word_parts of many words, one after another, and the word each belongs to."""
    found = _LETTERS_OR_END.findall(b"\n".join(words.to_pylist()).decode(errors="replace").lower())
    if not found:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    parts = pa.array(found, pa.string())
    ends = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
    return parts.filter(pa.array(~ends)), np.cumsum(ends)[~ends]


def _window_hashes(points: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` code points from starts on, counts of them each, one after another."""
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    found = np.full(len(at), length, dtype=np.uint64)
    for i in range(length):
        found = (found ^ points[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def gram_hashes(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words between their bounds, and how many each word has; a short word is one."""
    marked = [f"^{w}$" if length > 1 else w for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    counts = np.maximum(sizes - length + 1, 1)
    hashes, short = np.zeros(counts.sum(), np.uint64), sizes < length
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts
    long = np.repeat(~short, counts)
    hashes[long] = _window_hashes(points, starts[~short], counts[~short], length)
    for size in np.unique(sizes[short]):
        of_size = np.flatnonzero(sizes == size)
        hashes[first[of_size]] = _window_hashes(points, starts[of_size], np.ones(len(of_size), np.int64), int(size))
    return hashes, counts


@dataclass
class Model:
    """Known words and, by hash in ascending order, n-grams; their log frequencies, one column per language."""

    languages: list[str] = field(default_factory=list)
    words: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def logs(self, words: pa.Array) -> np.ndarray:
        """Log frequencies of words in each language, backed off where they are unknown."""
        found = np.zeros((len(words), len(self.languages)))
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        found[place >= 0] = self.word_logs[place[place >= 0]]
        left = np.flatnonzero(place < 0)
        names = words.take(pa.array(left)).to_pylist()
        for length in LENGTHS:
            if not len(left) or not len(self.grams):
                break
            hashes, counts = gram_hashes(names, length)
            at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
            known = self.grams[at] == hashes
            word = np.repeat(np.arange(len(names)), counts)
            n_known = np.bincount(word, weights=known, minlength=len(names))
            enough = 2 * n_known >= counts
            for i in range(len(self.languages)):
                sums = np.bincount(word[known], weights=self.gram_logs[at[known], i], minlength=len(names))
                found[left[enough], i] = sums[enough] / n_known[enough]
            left, names = left[~enough], [n for n, e in zip(names, enough) if not e]
        return found


def _counted(sample: DataFrame) -> DataFrame:
    """(word, lang, n) over the sample."""

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {name: i for i, name in enumerate(names)}
            of_row = np.array([number[x] for x in langs], dtype=np.int64)
            for low, high, data, offsets in text_slices(batch.column(0)):
                codes, words, first = coded_words(data, offsets)
                row = np.repeat(of_row[low:high], np.diff(first))
                seen, n = np.unique(codes.astype(np.int64) * len(names) + row, return_counts=True)
                parts = [word_parts(w) for w in words.to_pylist()]
                lines = [(p, names[s % len(names)], int(k)) for s, k in zip(seen.tolist(), n.tolist()) for p in parts[s // len(names)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*lines) if lines else ([], [], []), (pa.string(), pa.string(), pa.int64()))], names=["word", "lang", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "word string, lang string, n long")
    return counted.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _gram_column(length: int) -> Column:
    """grams() of the column ``word``."""
    marked = F.concat(F.lit("^"), "word", F.lit("$")) if length > 1 else F.col("word")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (length - 1), F.lit(1))),
                       lambda i: F.substring(marked, i, F.lit(length)))


def _logs(counts: DataFrame, name: str, languages: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The names of (name, lang, n) and their smoothed log frequency in each language. The sample's rows bound them."""
    rows = counts.select(name, "lang", "n").toArrow().combine_chunks()
    coded = rows[name].combine_chunks().dictionary_encode()
    names = coded.dictionary
    place = pc.index_in(rows["lang"].combine_chunks(), value_set=pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
    table = np.zeros((len(names), len(languages)))
    table[coded.indices.to_numpy(zero_copy_only=False), place] = rows["n"].to_numpy()
    return names, np.log((table + ALPHA) / (table.sum(axis=0) + ALPHA * max(len(names), 1)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, lang_rows: int = LANG_ROWS) -> Model:
    """Learn from the rows with a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text), F.lit("langid")).alias("hash"))
    # A share by hash of the text: copies teach once, and they neither fill the sample nor shrink it.
    sizes = stored(known.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    texts = sizes.agg(F.sum("n")).first()[0]
    if not texts:
        return Model()
    wanted = F.greatest(F.col("n") * F.lit(sample_rows / texts), F.lit(float(lang_rows))) / F.col("n")
    shares = sizes.select("lang", F.when(wanted < 1, F.floor(wanted * F.lit(1 << 40))).otherwise(1 << 40).alias("below"))
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod("hash", F.lit(1 << 40)) < F.col("below"))
    sample = stored(chosen.select("text", "lang").distinct(), "langid-sample")
    counts = stored(_counted(sample), "langid-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    words, word_logs = _logs(counts, "word", languages)

    # Distinct words count once: unknown words resemble the rare ones.
    lists = [_gram_column(n) for n in LENGTHS]
    found = counts.select("lang", F.explode(F.concat(*lists)).alias("gram")).groupBy("gram", "lang").agg(F.count("*").alias("n"))
    grams, gram_logs = _logs(found, "gram", languages)
    hashes = np.zeros(len(grams), np.uint64)
    sizes = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        of_size = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(grams.take(pa.array(of_size)).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        hashes[of_size] = _window_hashes(points, np.arange(len(of_size)) * size, np.ones(len(of_size), np.int64), int(size))
    order = np.argsort(hashes)
    return Model(languages, words, word_logs, hashes[order], gram_logs[order])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    place, size = names.index(text), len(model.languages)

    def judge(batches):
        for batch in batches:
            predicted, scores = [], []
            for low, high, data, offsets in text_slices(batch.column(place)):
                codes, words, first = coded_words(data, offsets)
                parts, of_word = parts_of(words)
                coded = parts.dictionary_encode()
                each = model.logs(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
                letters = np.bincount(of_word, minlength=len(words))
                table = np.stack([np.bincount(of_word, weights=each[:, i], minlength=len(words)) for i in range(size)], axis=1) \
                    if size else np.zeros((len(words), 0))
                n = high - low
                row = np.repeat(np.arange(n), np.diff(first))
                some = np.bincount(row, weights=letters[codes], minlength=n) > 0 if len(codes) else np.zeros(n, bool)
                if not size or not len(codes):
                    predicted += [UNKNOWN] * n
                    scores.append(np.zeros(n))
                    continue
                sums = np.stack([np.bincount(row, weights=table[codes, i], minlength=n) for i in range(size)], axis=1)
                best = sums.argmax(axis=1)
                share = 1 / np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                predicted += [model.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                scores.append(np.where(some, share, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(predicted, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(judge, schema)
