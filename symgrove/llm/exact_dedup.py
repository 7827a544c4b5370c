"""Exact duplicates by an index of live digests, each bucket with a cuckoo filter.

A text's digest is the SHA-256 of its words' text: white space runs become one
space. The index is a table of buckets dealt by digest. A bucket stores its
live digests with the smallest document of each and a count, and a cuckoo
filter over them: two places for each 16-bit fingerprint, four slots a place.
Digests of a batch, already summed per digest and task group, are looked up in
the filter; a hit is verified against the stored digests, a miss is new and is
inserted. Deleting takes the digest from the store and its fingerprint from
the filter. When an insertion finds no slot, the filter is made anew with twice
the places from the stored digests.

Copies never meet in one task: they are summed by (digest, salt) before the
shuffle, so a bucket sees at most SALTS rows per digest.

Defined results: null counts as empty; of equal texts the row with the
smallest doc_id stays, a null doc_id counting as largest; of rows that share
text and doc_id one stays; texts of any length are hashed whole; other columns
are carried; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from symgrove.llm.tables import stored
from symgrove.llm.words import SPACE_PATTERN

SALTS = 16
BUCKET_DIGESTS = 2048
SLOTS = 4
KICKS = 200
INDEX = "bucket long, filter binary, digests array<struct<digest: string, keep: long, n: long>>"


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with white space runs as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_PATTERN, " ").cast("binary"), 256)


class CuckooFilter:
    """Approximate set of digests with deletion; never misses what it holds."""

    def __init__(self, places: int):
        self.table = np.zeros((places, SLOTS), dtype=np.uint16)

    @classmethod
    def sized(cls, digests) -> "CuckooFilter":
        """A filter of all digests, doubled until each has a slot."""
        places = 1 << max(1, (int(len(digests) / (SLOTS * 0.85))).bit_length())
        while True:
            made = cls(places)
            if all(made.insert(d) for d in digests):
                return made
            places *= 2

    def _where(self, digest: str) -> tuple[int, int, int]:
        number = int(digest[-16:], 16)
        print_ = (number >> 48) or 1                       # 0 marks a free slot
        first = number & (len(self.table) - 1)
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return (place ^ (print_ * 0x5BD1E995)) & (len(self.table) - 1)

    def holds(self, digest: str) -> bool:
        print_, a, b = self._where(digest)
        return print_ in self.table[a] or print_ in self.table[b]

    def insert(self, digest: str) -> bool:
        """False if no slot was found: the filter then lacks some fingerprint and must be made anew."""
        print_, a, b = self._where(digest)
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        place = b
        for kick in range(KICKS):
            slot = kick % SLOTS
            print_, self.table[place, slot] = int(self.table[place, slot]), print_
            place = self._other(place, print_)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        return False

    def delete(self, digest: str) -> None:
        print_, a, b = self._where(digest)
        for place in (a, b):
            slots = np.flatnonzero(self.table[place] == print_)
            if len(slots):
                self.table[place, slots[0]] = 0
                return

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        made = cls(1)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return made


def _changed(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """One bucket after its changes: rows of new with n > 0 are insertions, with n null deletions."""
    live = {}
    seen = None
    for row in old.itertuples(index=False):
        live = {d["digest"]: [d["keep"], d["n"]] for d in row.digests}
        seen = CuckooFilter.from_bytes(row.filter)
    if seen is None:
        seen = CuckooFilter(1 << max(1, (int(len(new) / (SLOTS * 0.85))).bit_length()))
    for digest, keep, n in zip(new["digest"], new["keep"], new["n"]):
        known = live.get(digest) if seen.holds(digest) else None      # a hit is verified
        keep = None if pd.isna(keep) else int(keep)
        if pd.isna(n):
            if known is not None:
                del live[digest]
                seen.delete(digest)
        elif known is not None:
            known[1] += int(n)
            if keep is not None and (known[0] is None or keep < known[0]):
                known[0] = keep
        else:
            live[digest] = [keep, int(n)]
            if not seen.insert(digest):
                seen = CuckooFilter.sized(live)
    bucket = int((new if len(new) else old)["bucket"].iloc[0])
    return pd.DataFrame({"bucket": [bucket], "filter": [seen.to_bytes()],
                         "digests": [[{"digest": d, "keep": k, "n": n} for d, (k, n) in live.items()]]})


class DigestIndex:
    """Live digests of the documents inserted so far; every change gives a new stored index."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets

    @classmethod
    def empty(cls, spark: SparkSession, expected_rows: int) -> "DigestIndex":
        """Sized for about so many digests; with more it is made anew with more buckets."""
        return cls(spark.createDataFrame([], INDEX), max(1, -(-expected_rows // BUCKET_DIGESTS)))

    def _resized(self) -> "DigestIndex":
        """This index, or if its buckets overflow one of as many as its digests need, made from the stored digests."""
        # One number.
        n = self.table.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
        if n <= 2 * BUCKET_DIGESTS * self.buckets:
            return self
        return DigestIndex.empty(self.table.sparkSession, n)._with(self.live())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).alias("bucket")

    def _with(self, changes: DataFrame) -> "DigestIndex":
        changes = changes.select(self._bucket(), "digest", F.col("keep").cast("bigint").alias("keep"),
                                 F.col("n").cast("bigint").alias("n"))
        merged = self.table.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(_changed, INDEX)
        return DigestIndex(stored(merged, "digest-index"), self.buckets)

    def insert(self, rows: DataFrame) -> "DigestIndex":
        """rows: (key, digest), one per document. Buckets that overflow are split."""
        return self._inserted(rows)._resized()

    def _inserted(self, rows: DataFrame) -> "DigestIndex":
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
        return self._with(rows.groupBy("digest", salt.alias("salt")).agg(F.min("key").alias("keep"), F.count("*").alias("n")))

    def delete(self, digests: DataFrame) -> "DigestIndex":
        """digests: (digest), whose texts are live no more. Unknown ones change nothing."""
        return self._with(digests.select("digest").distinct().select(
            "digest", F.lit(None).alias("keep"), F.lit(None).alias("n")))

    def live(self) -> DataFrame:
        """(digest, keep, n) of every live digest."""
        return self.table.select(F.explode("digests").alias("d")).select("d.digest", "d.keep", "d.n")


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """docs with text_sha256, keep_id, group_size and kept, after inserting them into an index (an empty one by default).

    With an index given, copies of what was live before count too. Clashing columns of docs are replaced.
    """
    docs = docs.drop("text_sha256", "keep_id", "group_size", "kept")
    digests = stored(docs.select(F.col(key).cast("bigint").alias("key"), text_digest(F.col(text)).alias("digest")), "digests")
    # An index of its own is sized for all rows.
    index = index.insert(digests) if index else DigestIndex.empty(docs.sparkSession, digests.count())._inserted(digests)
    live = stored(index.live(), "live-digests")
    hashed = docs.withColumn("text_sha256", text_digest(F.col(text)))
    joined = hashed.join(live.select(F.col("digest").alias("text_sha256"), F.col("keep").alias("keep_id"),
                                     F.col("n").alias("group_size")), "text_sha256")
    # Rows of one text and one doc_id: the first stays. Dealt anew, as one text may hold most rows.
    joined = joined.repartition("text_sha256", key)
    first = F.row_number().over(Window.partitionBy("text_sha256", key, "keep_id").orderBy("group_size")) == 1
    return joined.select(*docs.columns, "keep_id", "group_size",
                         (F.col(key).eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    return mark_duplicates(docs, key, text).where("kept").select(*docs.columns)
