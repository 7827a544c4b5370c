"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). For a query q and a vector x split
into equal segments, each segment's mean and deviation bound their distance
from below: sum over segments of L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2).
As |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, that bounds the inner product from
above. Bounds are taken from one segment to many; a vector stays a survivor
while its bound reaches the k-th best product that the query has so far, and
exact products are computed for survivors alone.

Vectors are dealt to shards by ranges of a coarse key, the size of the vector
and the interleaved means of its segments, so that a shard's vectors resemble
each other; a shard keeps the least and the greatest of each statistic. Queries
first search the shard they lie in, which gives each a k-th best product. Then
a query goes only to those other shards whose statistics allow a product that
large. Within a shard a task sees pairs of one query block and one vector block
of bounded size and keeps the best k of the current query block; the tasks'
lists are cut to k per query at the end. Nothing is left out: bounds only skip
what can't be among the best.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; rows that share an id are vectors of
their own, of which none is a candidate for another, and as queries they share
one list; equal rows count each; shorter vectors are extended by zeros, long
ones are taken whole; ties go to the smaller id; products must fit into 64
bits; a query alone has no rows, an empty table none. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from symgrove.llm.tables import stored

VECTORS_A_BLOCK = 2048
QUERIES_A_BLOCK = 512
SHARD_ROWS = 1024
MOST_SMALL_SHARDS = 64
LARGE_SHARD_ROWS = 1 << 20
# Shards at most, beyond which they grow instead; their statistics are sent to all tasks.
MOST_SHARDS = 1 << 16
SEGMENTS = (1, 4, 16)
# Segments of the coarse key and of a shard's statistics, and bits of each mean in the key.
COARSE, COARSE_BITS = 4, 8
# Pairs whose exact products are computed at a time; share of pairs above which all of a block are multiplied at once.
PAIRS = 1 << 17
DENSE = 0.05


def _table(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of integers as lines, shorter ones extended by zeros."""
    sizes = lists.value_lengths().to_numpy()
    table = np.zeros((len(lists), int(sizes.max(initial=0)) if width is None else width), dtype=np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return table


def _packed(number: int, shard: int, ids: np.ndarray, table: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
    """One block: its name, shard, ids, integers and, of queries, the least product that counts."""
    columns = {"block": pa.array([number]), "shard": pa.array([shard]),
               "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "ints": pa.array([table.tobytes()], pa.binary())}
    if least is not None:
        columns["least"] = pa.array([least.astype(np.float64).tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _numbers():
    """Names for blocks that no other task gives."""
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1


def _blocks(rows: int):
    """A function that packs batches of (id, ints, shard) into blocks of one shard and at most so many rows."""

    def pack(batches):
        names = _numbers()
        for batch in batches:
            shards = batch.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
            for begin, end in zip(edges, edges[1:]):
                for low in range(begin, end, rows):
                    part = batch.slice(low, min(rows, end - low))
                    yield _packed(next(names), int(shards[low]), part.column(0).to_numpy(), _table(part.column(1)))

    return pack


def _coarse(batches, width: int):
    """(id, ints, place, stats): the coarse key and the segments' statistics, all of one width."""
    for batch in batches:
        table = _table(batch.column(1), width)
        stats = statistics(table, COARSE)
        size = np.sqrt((table.astype(np.float64) ** 2).sum(axis=1))
        place = np.clip(np.frexp(size)[1], 0, 1023).astype(np.int64) << (COARSE * COARSE_BITS)
        means = np.clip((stats[:, ::2] / np.maximum(size, 1e-9)[:, None] + 1) / 2, 0, 1) * ((1 << COARSE_BITS) - 1)
        for bit in range(COARSE_BITS):
            for i, column in enumerate(means.astype(np.int64).T):
                place |= (column >> bit & 1) << (bit * COARSE + i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(place), pa.FixedSizeListArray.from_arrays(
                pa.array(np.pad(stats, ((0, 0), (0, 2 * COARSE - stats.shape[1]))).ravel()), 2 * COARSE).cast(pa.list_(pa.float64()))],
            names=["id", "ints", "place", "stats"])


def _unpack(ids: bytes, ints: bytes, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    table = np.frombuffer(ints, np.int64).reshape(len(ids), -1)
    if width is not None and table.shape[1] < width:
        table = np.pad(table, ((0, 0), (0, width - table.shape[1])))
    return ids, table


def statistics(table: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment: products of two lines bound the vectors' product."""
    parts = np.array_split(table.astype(np.float64), min(segments, max(table.shape[1], 1)), axis=1)
    columns = []
    for part in parts:
        root = np.sqrt(part.shape[1])
        columns += [part.mean(axis=1) * root, part.std(axis=1) * root] if part.shape[1] else []
    return np.stack(columns, axis=1) if columns else np.zeros((len(table), 1))


def _in_doubles(q: np.ndarray, x: np.ndarray) -> bool:
    """True if sums of products stay below 2^53, where doubles hold every integer."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) < 2.0**53


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (rows, columns)."""
    kind = np.float64 if _in_doubles(q, x) else np.int64
    found = [np.einsum("ij,ij->i", q[rows[i:i + PAIRS]].astype(kind), x[columns[i:i + PAIRS]].astype(kind))
             for i in range(0, len(rows), PAIRS)]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


class _Best:
    """The k best (score, id) of each query of one block so far; ties to the smaller id."""

    def __init__(self, n: int, k: int, threshold: np.ndarray | None = None):
        self.k, self.rows = k, np.zeros(0, np.int64)
        self.ids = self.scores = self.rows
        self.threshold = np.full(n, -np.inf) if threshold is None else threshold.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]
        full = rank[kept] == self.k - 1
        self.threshold[self.rows[full]] = np.maximum(self.threshold[self.rows[full]], self.scores[full])


def search_block(query: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], best: _Best) -> int:
    """Add a block's vectors to the best of a query block; returns how many survivors' products it took."""
    (query_ids, q), (ids, x) = query, block
    threshold, k = best.threshold, min(best.k, len(ids))
    alive = query_ids[:, None] != ids[None, :]
    for segments in SEGMENTS:
        a, b = statistics(q, segments), statistics(x, segments)
        if alive.mean() > DENSE:
            bound = np.where(alive, a @ b.T, -np.inf)
        else:
            rows, columns = np.nonzero(alive)
            bound = np.full(alive.shape, -np.inf)
            bound[rows, columns] = np.einsum("ij,ij->i", a[rows], b[columns])
        # The vectors that look best at this resolution raise the threshold.
        columns = np.argpartition(bound, len(ids) - k, axis=1)[:, len(ids) - k:].ravel()
        rows = np.repeat(np.arange(len(q)), k)
        real = alive[rows, columns]
        rows, columns = rows[real], columns[real]
        trial = _Best(len(q), best.k)
        trial.add(rows, ids[columns], _exact(q, x, rows, columns))
        threshold = np.maximum(threshold, trial.threshold)
        alive &= bound >= _least(threshold)[:, None]
    rows, columns = np.nonzero(alive)
    if alive.mean() > DENSE and _in_doubles(q, x):
        scores = (q.astype(np.float64) @ x.T.astype(np.float64))[rows, columns].astype(np.int64)
    else:
        scores = _exact(q, x, rows, columns)
    reach = scores >= threshold[rows]
    best.add(rows[reach], ids[columns[reach]], scores[reach])
    return len(rows)


def _least(threshold: np.ndarray) -> np.ndarray:
    """Bounds below this can't reach the threshold, whatever a bound's rounding."""
    return np.where(np.isfinite(threshold), threshold - 1e-9 * np.abs(threshold) - 1e-6, -np.inf)


def top_k(vectors: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", k: int = 5,
          scale: float = 256.0) -> DataFrame:
    """query_id, rank, key and score of the k largest integer products of every query with the other rows.

    is_query: SQL condition on ``id`` that tells queries.
    """
    component = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    known = (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite)
             .select(F.col(key).cast("bigint").alias("id"), F.transform(vector, component).cast("array<bigint>").alias("ints")))
    known = stored(known, "vectors")
    rows, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    shards = min(max(1, min(MOST_SMALL_SHARDS, rows // SHARD_ROWS), rows // LARGE_SHARD_ROWS), MOST_SHARDS)
    placed = known.mapInArrow(lambda batches: _coarse(batches, width), "id long, ints array<long>, place long, stats array<double>")
    dealt = stored(placed.repartitionByRange(shards, "place", "id").withColumn("shard", F.spark_partition_id().cast("bigint")),
                   "vectors-by-shard")
    ends = [f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(2 * COARSE)]
    # One row of 16 numbers per shard.
    boxes = dealt.groupBy("shard").agg(*ends).orderBy("shard").collect()
    names = np.array([b["shard"] for b in boxes])
    low, high = (np.array([[b[f"{f}{i}"] for i in range(2 * COARSE)] for b in boxes]).reshape(-1, 2 * COARSE) for f in ("min", "max"))

    kind = "block long, shard long, ids binary, ints binary"
    blocks = stored(dealt.select("id", "ints", "shard").mapInArrow(_blocks(VECTORS_A_BLOCK), kind), "vector-blocks")
    asked = dealt.where(is_query).select("id", "ints", "shard")

    def search(batches):
        current, query, best = None, None, None

        def result():
            return pa.RecordBatch.from_arrays([pa.array(query[0][best.rows]), pa.array(best.ids), pa.array(best.scores)],
                                              names=["query_id", key, "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, query_ids, query_ints, least, ids, ints = (batch.column(c)[i].as_py() for c in range(6))
                if name != current:                              # pairs of one query block follow each other
                    if best is not None:
                        yield result()
                    current, query = name, _unpack(query_ids, query_ints)
                    best = _Best(len(query[0]), k, None if least is None else np.frombuffer(least))
                block = _unpack(ids, ints, query[1].shape[1])
                wide = (query[0], np.pad(query[1], ((0, 0), (0, block[1].shape[1] - query[1].shape[1]))))
                search_block(wide, block, best)
        if best is not None:
            yield result()

    def searched(queries: DataFrame) -> DataFrame:
        pairs = queries.select(F.col("block").alias("query_block"), "shard", F.col("ids").alias("query_ids"),
                               F.col("ints").alias("query_ints"), "least").join(blocks, "shard")
        return pairs.select("query_block", "query_ids", "query_ints", "least", "ids", "ints").mapInArrow(
            search, f"query_id long, `{key}` long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    at_home = asked.mapInArrow(_blocks(QUERIES_A_BLOCK), kind).withColumn("least", F.lit(None).cast("binary"))
    first = stored(searched(at_home).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best-at-home")
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)

    def send(batches):
        blocks_ = _numbers()
        for batch in batches:
            for begin in range(0, batch.num_rows, QUERIES_A_BLOCK):
                part = batch.slice(begin, QUERIES_A_BLOCK)
                ids, table, home = part.column(0).to_numpy(), _table(part.column(1), width), part.column(2).to_numpy()
                least = part.column(3).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                stats = np.pad(statistics(table, COARSE), ((0, 0), (0, 2 * COARSE)))[:, :2 * COARSE]
                for at in range(0, len(names), 1024):            # the greatest product that a shard's box allows
                    parts = slice(at, at + 1024)
                    bound = np.maximum(stats, 0) @ high[parts].T + np.minimum(stats, 0) @ low[parts].T
                    wanted = (bound >= _least(least)[:, None]) & (home[:, None] != names[None, parts])
                    for s in np.flatnonzero(wanted.any(axis=0)):
                        rows_ = wanted[:, s]
                        yield _packed(next(blocks_), int(names[at + s]), ids[rows_], table[rows_], least[rows_])

    away = asked.join(reached.select(F.col("query_id").alias("id"), "least"), "id", "left").select("id", "ints", "shard", "least")
    found = first.unionByName(searched(away.mapInArrow(send, kind + ", least binary")))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", key, "score"))
