"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target of words; target / size is how often its documents
are to be taken on average, from 0 to 2. The whole part is certain. The
fractional part is an inclusion probability, and the cube method settles it:
probabilities move along vectors that change neither the expected number of
documents nor the expected number of words of the source, until each is 0 or
1. With two constraints three undecided documents always allow such a move, so
a walk that holds three at a time leaves two at most (the landing problem).

A source is walked in chunks of CHUNK documents chosen by hash, whatever its
size; what the chunks leave is walked again in chunks, level by level, until a
source has one chunk, whatever the other sources have. Its last two documents
are landed so that the words miss the target least, and TURNS others at most
are turned over where that brings the words nearer: any of a source of one
chunk, and of a larger one settled documents that each chunk hands on with
those it leaves, HELD for 0 and for 1 of each power of two of words, the
largest first. Only keys and sizes take part, never texts.

Defined results: a null or empty text has size 0 and takes nothing; a very
long text is one document like others, its words counted whole; a null source
is a source of its own, last in order; of rows equal in key, source and size
the expected number, rounded down, is taken for certain and one more row is
left to the cube, which of them is taken is arbitrary; a source without words
has target 0; clashing columns are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from symgrove.llm.order import positions, running_sums
from symgrove.llm.tables import stored
from symgrove.llm.words import word_count
from symgrove.plans.skew import sliced_row_number

# By rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CHUNK = 2000
# Settled documents that the landing of a source may turn over.
TURNS = 12
# Settled documents that a chunk hands on for that, of each outcome and power of two of words.
HELD = 2
TINY = 1e-9
# Row numbers of one slice when rows that are alike are numbered.
SLICE_ROWS = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size), one row per source.

    The sum share * all sizes is split by weight. A target stops at most times
    its source's size and what is over goes to the others by weight: the
    targets are min(most * size, weight * level) for the one level that spends
    the whole sum.
    """
    named = positions(sizes.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], "sources-by-name", "rank")
    weighed = named.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running_sums(positions(weighed, ["ratio", "rank"], "sources-by-ratio"), ["cap", "weight"])
    # Two numbers: all words and all weights.
    words, whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # The first source, by ratio, that the level does not fill says what the level is. One number.
    reach = (F.lit(float(words)) * F.lit(share) - F.col("cap_before")) / (F.lit(whole) - F.col("weight_before"))
    level = filled.where(F.col("ratio") > reach).agg(F.min_by(reach, "position")).first()[0]
    # Without an open source (no words at all) every target is its cap.
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * F.lit(level))
    return weighed.select("source", "n", "source_size", target.alias("target"))


def flight(part: np.ndarray, count: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Probabilities after the walk: all but two at most are 0 or 1; count and size keep their expected sums."""
    part, moves = part.copy(), iter(draw.random(2 * len(part) + 8))
    waiting, held = iter(np.flatnonzero((part > TINY) & (part < 1 - TINY)).tolist()), []
    while True:
        while len(held) < 3 and (i := next(waiting, None)) is not None:
            held.append(i)
        if len(held) < 3:
            return part
        c, s = count[held], size[held]
        step = np.array([c[1] * s[2] - c[2] * s[1], c[2] * s[0] - c[0] * s[2], c[0] * s[1] - c[1] * s[0]])
        largest = np.abs(step).max()
        if largest < 1e-12 * max(np.abs(s).max(), 1) * np.abs(c).max():
            step, largest = np.array([c[1], -c[0], 0.0]), max(c[0], c[1])   # sizes in proportion to counts
        step = step / largest
        p, moving = part[held], np.abs(step) > 1e-12
        up, down = np.where(step > 0, 1 - p, p), np.where(step > 0, p, 1 - p)
        far = np.where(moving, np.abs(step), 1.0)
        ahead, back = np.where(moving, up / far, np.inf).min(), np.where(moving, down / far, np.inf).min()
        p = np.clip(p + step * (ahead if next(moves) * (ahead + back) < back else -back), 0, 1)
        p[p < TINY], p[p > 1 - TINY] = 0, 1
        part[held] = p
        held = [i for i in held if 0 < part[i] < 1]


def landing(part: np.ndarray, count: np.ndarray, size: np.ndarray, wanted: np.ndarray, held: np.ndarray | bool = False) -> np.ndarray:
    """Settle the last undecided documents, then turn over few others, so that the words are near what was wanted.

    part: after the walk; wanted: the probabilities before it, whose documents may be turned, as may held ones,
    which were settled before.
    """
    part, open_ = part.copy(), np.flatnonzero((part > 0) & (part < 1))
    if len(open_):
        ways = np.array(np.meshgrid(*[[0.0, 1.0]] * len(open_))).reshape(len(open_), -1).T
        moved = ways - part[open_]
        part[open_] = ways[min(range(len(ways)), key=lambda i: (abs(moved[i] @ size[open_]), abs(moved[i] @ count[open_]), i))]
    free = (wanted > TINY) & (wanted < 1 - TINY) | held
    for _ in range(TURNS):
        off = (part - wanted) @ size
        after = np.where(free, np.abs(off + (1 - 2 * part) * size), np.inf)
        best = int(after.argmin()) if len(after) else 0
        if not len(after) or not after[best] < abs(off) - TINY:
            break
        part[best], free[best] = 1 - part[best], False
    return part


def _handed_on(part: np.ndarray, size: np.ndarray, wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which settled documents stay held, by size descending: HELD of each outcome and power of two of words."""
    free = ((wanted > TINY) & (wanted < 1 - TINY) | held) & ((part == 0) | (part == 1)) & (size > 0)
    kinds = pd.DataFrame({"free": free, "part": part, "power": np.frexp(size)[1]})
    return free & (kinds.groupby(["free", "part", "power"]).cumcount() < HELD).to_numpy()


def _walk(level: int):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["words", "order"], ascending=[False, True], kind="stable")
        name = f"{level}:{group['source'].iloc[0]}:{group['chunk'].iloc[0]}"
        count, size = group["rows"].to_numpy(float), group["words"].to_numpy(float)
        wanted, held = group["part"].to_numpy(float), group["held"].to_numpy(bool)
        part = flight(wanted, count, size, np.random.default_rng(zlib.crc32(name.encode())))
        if group["last"].iloc[0]:
            return group.assign(part=landing(part, count, size, wanted, held), held=False)
        return group.assign(part=part, held=_handed_on(part, size, wanted, held))

    return walk


def decisions(units: DataFrame) -> DataFrame:
    """units with part settled to 0 or 1: (key, source, size, rows, words, part, order, ...)."""
    undecided = (F.col("part") > TINY) & (F.col("part") < 1 - TINY)
    open_ = units.where(undecided).withColumn("held", F.lit(False))
    schema = open_.withColumn("chunk", F.lit(0).cast("bigint")).withColumn("last", F.lit(False)).schema
    settled, level = [units.where(~undecided).withColumn("part", F.round("part"))], 0
    while True:
        counts = stored(open_.groupBy("source").agg(F.count_if(undecided).alias("n_open")), "open-units")
        most = counts.agg(F.max("n_open")).first()[0] or 0
        chunks = F.greatest(F.ceil(F.col("n_open") / CHUNK), F.lit(1))
        named = counts.select(F.col("source").alias("name"), "n_open")
        dealt = (open_.join(named, F.col("source").eqNullSafe(F.col("name")))
                 .withColumn("chunk", F.pmod(F.xxhash64("order", F.lit(level)), chunks))
                 .withColumn("last", F.col("n_open") <= CHUNK).select(*schema.names))
        walked = stored(dealt.groupBy("source", "chunk").applyInPandas(_walk(level), schema), "walked-units").drop("chunk", "last")
        settled.append(walked.where("part IN (0, 1) AND NOT held").drop("held"))
        if most <= CHUNK:
            break
        open_, level = walked.where("part NOT IN (0, 1) OR held"), level + 1
    done = settled[0]
    for more in settled[1:]:
        done = done.union(more)
    return done


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS,
        share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes the row) and taken (its words)."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", word_count(F.col(text)))
    units = stored(sized.groupBy(F.col(key).alias("key"), F.col(source).alias("source"), "size").agg(F.count("*").alias("rows"))
                   .withColumn("words", F.col("rows") * F.col("size")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum("rows").alias("n"), F.sum("words").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "source-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = targets.withColumnRenamed("source", "name")
    # Of rows that are alike as many as their parts add up to are certain to be taken once more; one row is left to the cube.
    over = F.col("rows") * F.greatest(rate - F.floor(rate + TINY), F.lit(0.0))
    rated = units.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "key", "source", "size", F.col("rows").alias("alike"), F.lit(1).alias("rows"), F.col("size").alias("words"),
        "source_size", "target", F.floor(rate + TINY).alias("whole"), F.floor(over + TINY).alias("certain"),
        F.xxhash64("key", "source", "size").alias("order"),
        F.greatest(over - F.floor(over + TINY), F.lit(0.0)).alias("part"))
    chosen = stored(decisions(rated), "decisions").select(
        F.col("key").alias("_d_key"), F.col("source").alias("_d_source"), F.col("size").alias("_d_size"), "source_size", "target",
        F.col("alike").alias("_alike"), F.col("whole").alias("_whole"),
        (F.col("certain") + F.col("part").cast("bigint")).alias("_once_more"))
    same = (F.col(key).eqNullSafe(F.col("_d_key")) & F.col(source).eqNullSafe(F.col("_d_source")) & (F.col("size") == F.col("_d_size")))
    taken = sized.withColumn("_row", F.monotonically_increasing_id()).join(chosen, same)
    dealt = taken.where("_alike = 1").withColumn("_nth", F.lit(1))
    if not chosen.where("_alike > 1").isEmpty():
        # A group of rows that are alike may be large: numbered in slices.
        dealt = dealt.unionByName(sliced_row_number(
            taken.where("_alike > 1"), ["_d_key", "_d_source", "_d_size"], ["_row"], F.floor(F.col("_row") / SLICE_ROWS), "_nth"))
    copies = F.col("_whole") + (F.col("_nth") <= F.col("_once_more")).cast("bigint")
    return dealt.withColumn("copies", copies).select(*docs.columns, "size", "source_size", "target", "copies",
                                                     (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, as often as it takes them, with the columns of docs, whatever their names."""
    clashing = {c: f"_own_{c}" for c in ("size", "source_size", "target", "copies", "taken", "copy") if c in docs.columns}
    taken = mix(docs.withColumnsRenamed(clashing), **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        *[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])
