"""Toxicity by weak supervision.

Many weak voters look at a text. Lexicon voters are words and word beginnings
that a sample of labelled rows shows in toxic texts far more than in others;
pattern voters look at how often and how densely such words stand, at capitals,
marks, repeated words and length. A generative model takes the unseen truth of
each sample text to have caused all its votes: expectation maximisation
estimates each voter's rate of firing given either truth, with the known label
as one more voter whose accuracy is estimated too. Voters that fire together
more than that truth explains are correlated, and share their weight. A linear
classifier is then trained on the posterior of the sample and scores every
text of the corpus.

The sample is bounded: at most SAMPLE_ROWS labelled rows, those of the
smallest hashes; what is fetched from it are counts of the best VOTERS words
per text, never texts. Scoring is one pass over whole texts without a shuffle.

Defined results: a null, empty or wordless text is scored like any text, by
the patterns alone; a text of any length is scored whole; bytes that are not
UTF-8 are no letters; repeated rows and equal keys are scored row by row, and
of the texts of one key the smallest teaches; a label that is null or whose
document is missing teaches nothing; repeated labels of one document count
once, as the largest; without labels every score is NO_LABELS; other columns
are carried, one named like the score is replaced; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from symgrove.llm.langid import parts_of, word_parts
from symgrove.llm.tables import stored
from symgrove.llm.words import coded_words, text_slices

SAMPLE_ROWS = 20_000
VOTERS = 400
# Word beginnings of these lengths are candidates beside whole words.
STEMS = (4, 5, 6, 7)
LEAST_TEXTS = 4
EM_ROUNDS = 40
TRAIN_ROUNDS = 400
NO_LABELS = 0.0
THRESHOLD = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a"):ord("z") + 1] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?"), ord("*"), ord("#")]] = True


def _features(word: bytes) -> set[str]:
    """Names of the lexicon candidates in one word: ``=word`` and ``beginning``."""
    found = set()
    for run in word_parts(word):
        found.add("=" + run)
        found.update(run[:n] for n in STEMS if len(run) > n)
    return found


def candidate_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, other): number of sample texts of either label that hold each candidate."""

    def count(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for low, high, data, offsets in text_slices(batch.column(0)):
                codes, words, first = coded_words(data, offsets)
                names, number = [], {}
                of_word = [[number.setdefault(f, len(number)) for f in _features(w)] for w in words.to_pylist()]
                names = list(number)
                tally = np.zeros((len(names), 2), np.int64)
                for row in range(high - low):
                    held = np.unique(np.fromiter((f for c in np.unique(codes[first[row]:first[row + 1]]) for f in of_word[c]), np.int64))
                    tally[held, 0 if toxic[low + row] else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tally[:, 0]), pa.array(tally[:, 1])],
                                                 names=["feature", "toxic", "other"])

    counted = sample.select("text", "toxic").mapInArrow(count, "feature string, toxic long, other long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


@dataclass
class Model:
    """Weights over lexicon voters and patterns; empty without labels."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0


PATTERNS = 10


def lexicon_hits(words: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, voter) of distinct words that hold lexicon voters, all looked up together."""
    runs, of_word = parts_of(words)
    names = pa.array(list(lexicon), pa.string())
    sizes = pc.utf8_length(runs).to_numpy(zero_copy_only=False)
    found = [(of_word, pc.binary_join_element_wise(pa.scalar("="), runs, ""))]
    for n in STEMS:
        longer = np.flatnonzero(sizes > n)
        found.append((of_word[longer], pc.utf8_slice_codeunits(runs.take(pa.array(longer)), 0, n)))
    number = np.fromiter(lexicon.values(), np.int64, len(lexicon))
    pairs = [np.zeros((0, 2), np.int64)]
    for which, features in found:
        at = pc.index_in(features.cast(pa.string()), value_set=names)
        held = at.is_valid().to_numpy(zero_copy_only=False)
        pairs.append(np.stack([which[held], number[at.drop_null().to_numpy()]], axis=1))
    both = np.unique(np.concatenate(pairs), axis=0)
    return both[:, 0], both[:, 1]


def votes_of(data: np.ndarray, offsets: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """One line per text: lexicon voters (1 if it fires), then patterns from 0 to 1."""
    n = len(offsets) - 1
    codes, words, first = coded_words(data, offsets)
    counts, of_row = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    votes = np.zeros((n, len(lexicon) + PATTERNS), dtype=np.float32)
    # Each text's distinct words, and how often they stand there.
    pairs, times = np.unique(of_row * max(len(words), 1) + codes, return_counts=True)
    row, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
    hit_word, voter = lexicon_hits(words, lexicon)
    hits = np.bincount(hit_word, minlength=len(words)) if len(words) else np.zeros(1, np.int64)
    at = np.flatnonzero(hits[word] > 0)
    begin = np.concatenate([[0], np.cumsum(hits)])[word[at]]
    fired = np.repeat(begin - np.concatenate([[0], np.cumsum(hits[word[at]])[:-1]]), hits[word[at]]) + np.arange(hits[word[at]].sum()) \
        if len(at) else np.zeros(0, np.int64)
    votes[np.repeat(row[at], hits[word[at]]), voter[fired]] = 1
    total = np.bincount(row[at], weights=times[at], minlength=n)
    distinct, kinds = np.bincount(row[at], minlength=n), np.bincount(row, minlength=n)
    sums = lambda flags: np.add.reduceat(np.append(flags, 0), offsets[:-1]) * (np.diff(offsets) > 0)
    letters = np.maximum(sums(_LETTER[data].astype(np.int64)), 1)
    size = np.maximum(np.diff(offsets), 1)
    votes[:, len(lexicon):] = np.stack([
        total >= 1, total >= 2, total >= 3, distinct >= 2, distinct >= 3, total > 0.005 * counts,
        sums(_UPPER[data].astype(np.int64)) > 0.5 * letters, sums(_SHOUT[data].astype(np.int64)) > 0.03 * size,
        kinds < 0.4 * counts, counts < 20], axis=1)
    return votes


def posterior(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic) of each sample text by the generative model of votes and labels."""
    n, m = votes.shape
    belief = np.where(labels > 0.5, 0.8, labels.mean() * 0.2)          # a start, not a verdict
    weight = np.ones(m)
    for round_ in range(EM_ROUNDS):
        prior = np.clip(belief.mean(), 1e-3, 1 - 1e-3)
        rates = [(votes.T @ b + 0.5 * votes.mean(axis=0) + 0.01) / (b.sum() + 0.52) for b in (belief, 1 - belief)]
        rates = [np.clip(r, 1e-4, 1 - 1e-4) for r in rates]
        right = np.clip((belief * labels + (1 - belief) * (1 - labels)).mean(), 0.6, 0.995)
        if round_ and round_ % 10 == 0:
            # Firing that the truth does not explain: correlations of the residuals share weight.
            residual = votes - belief[:, None] * rates[0] - (1 - belief)[:, None] * rates[1]
            spread = residual.std(axis=0) + 1e-6
            correlation = np.abs((residual.T @ residual) / n / spread[:, None] / spread)
            weight = 1 / np.maximum(np.where(correlation > 0.1, correlation, 0).sum(axis=1), 1)
        fires = np.log(rates[0] / rates[1]) * weight
        quiet = np.log((1 - rates[0]) / (1 - rates[1])) * weight
        known = np.log(right / (1 - right)) * (2 * labels - 1)
        logit = np.log(prior / (1 - prior)) + votes @ (fires - quiet) + quiet.sum() + known
        belief = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return belief


def _train(votes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; both classes weigh alike up to tenfold."""
    n, m = votes.shape
    weights, bias, step, bias_step = np.zeros(m), 0.0, np.zeros(m), 0.0
    share = np.clip(target.mean(), 0.1, 0.9)
    importance = target / share + (1 - target) / (1 - share)
    for _ in range(TRAIN_ROUNDS):
        error = importance * (1 / (1 + np.exp(-np.clip(votes @ weights + bias, -30, 30))) - target)
        step = 0.9 * step + (votes.T @ error / n + 1e-4 * weights)
        bias_step = 0.9 * bias_step + error.mean()
        weights, bias = weights - 0.5 * step, bias - 0.5 * bias_step
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows of labels (key, label) and the texts that they name."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
              .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("key"), "key").limit(sample_rows))
    # The sample's keys are sample_rows pairs at most.
    sample = stored(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
                    .join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")),
                    "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    if not n_toxic or not n_other:
        return Model()
    rate_toxic, rate_other = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("other") + 0.5) / (n_other + 1)
    best = (candidate_counts(sample).where(F.col("toxic") >= LEAST_TEXTS)
            .withColumn("lift", F.log(rate_toxic / rate_other)).where("lift > 1.6")
            .withColumn("gain", F.col("lift") * F.col("toxic"))
            .orderBy(F.desc("gain"), "feature").limit(VOTERS))
    lexicon = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}

    def look(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for low, high, data, offsets in text_slices(batch.column(0)):
                votes = np.packbits(votes_of(data, offsets, lexicon).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in votes], pa.binary()),
                                                  pa.array(toxic[low:high].astype(np.int32))], names=["votes", "toxic"])

    # Bits of at most sample_rows texts.
    seen = sample.select("text", "toxic").mapInArrow(look, "votes binary, toxic int").toPandas()
    order = np.lexsort((seen["toxic"], seen["votes"]))
    width = len(lexicon) + PATTERNS
    votes = np.unpackbits(np.frombuffer(b"".join(seen["votes"].iloc[order]), np.uint8).reshape(len(seen), -1), axis=1)[:, :width].astype(float)
    truth = posterior(votes, seen["toxic"].to_numpy()[order].astype(float))
    weights, bias = _train(votes, truth)
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in the column into; every row and whole text, in place."""
    fields = [f for f in docs.schema.fields if f.name != into]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{into}` double"
    place = names.index(text)

    def judge(batches):
        for batch in batches:
            scores = np.full(batch.num_rows, NO_LABELS)
            if model.weights is not None:
                for low, high, data, offsets in text_slices(batch.column(place)):
                    logit = votes_of(data, offsets, model.lexicon) @ model.weights + model.bias
                    scores[low:high] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, into])

    return docs.select(*names).mapInArrow(judge, schema)
