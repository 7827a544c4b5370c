"""Near-duplicate documents by HyperMinHash.

One pass over the texts hashes each document's distinct word shingles into 256
buckets. A bucket's register keeps, of its smallest hash, the count of leading
zeros and the ten bits after the first one: 16 bits. Empty registers borrow
from other buckets in an order fixed for each bucket, so that small sets have
bands too, and bands of six registers are hashed into keys. Documents that
share a key are candidates. Before a candidate pair is verified on the full
sets, its Jaccard similarity is estimated from the registers, less the matches
that compressed registers show by chance; only a pair far below the threshold
is left out there (ESTIMATE_SIGMAS standard deviations, so about one true link
in 10^6; a true pair at the threshold shares no band with a chance of 3 in
10^6, at 0.85 of 3 in 10^9).

No group emits all its pairs at once. Documents of equal sets are one member
of the join. Within a key, every member is compared with the one that meets
most others (the centre of a group of near copies), whose links already join
nearly all. Members of keys that then still span components are compared across
components where prefix filtering of their full sets allows a link. So hot keys cost
their size, and no link that could change a component is lost. All steps are joins and aggregations on tables in
the shared folder, whose skewed keys adaptive execution can split.

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle; a text of
any length has its full set; words are bytes, UTF-8 or not; rows with
one doc_id are one document, linked with each other; a null doc_id is linked
with nothing and kept, with a null component; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from symgrove.llm.components import components
from symgrove.llm.tables import stored
from symgrove.llm.words import mixed, shingles, text_slices

BUCKETS, BUCKET_BITS = 256, 8
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
BAND_ROWS = 6
BANDS = BUCKETS // BAND_ROWS
ESTIMATE_SIGMAS = 4.75
# Members of a prefix shingle from which on sizes are part of its key.
HOT_MEMBERS = 200
# The constant of the expected number of chance matches between compressed registers.
CHANCE = 0.169919487159739093975315012348

# For every bucket the other buckets in the order in which it borrows from them.
_BORROW = np.stack([np.random.default_rng(i).permutation(BUCKETS) for i in range(BUCKETS)])


def registers_of(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Compressed registers, one line of BUCKETS for each row."""
    least = np.full(n_rows * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, rows * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), hashes >> np.uint64(BUCKET_BITS))
    # Bits of the number: frexp on the top half, then on the rest, both exact in a double.
    high, low = (least >> np.uint64(28)).astype(np.float64), (least & np.uint64((1 << 28) - 1)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 28, np.frexp(low)[1]).astype(np.int64)
    zeros = np.clip(64 - BUCKET_BITS - bits, 0, 63)
    left = np.clip(bits - 1 - MANTISSA, 0, 63).astype(np.uint64)
    right = np.clip(MANTISSA - bits + 1, 0, MANTISSA).astype(np.uint64)
    mantissa = ((least >> left) << right) & np.uint64((1 << MANTISSA) - 1)
    found = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, found).reshape(n_rows, BUCKETS)


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers whose empty places borrow; lines that are all empty stay so."""
    out = registers.copy()
    some = np.flatnonzero((registers == EMPTY).any(axis=1) & (registers != EMPTY).any(axis=1))
    for step in range(BUCKETS):
        if not len(some):
            break
        part = out[some]
        empty = part == EMPTY
        part[empty] = registers[some][:, _BORROW[:, step]][empty]
        out[some] = part
        some = some[(part == EMPTY).any(axis=1)]
    return out


def bands_of(registers: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a line."""
    parts = filled(registers)[:, :BANDS * BAND_ROWS].astype(np.uint64).reshape(len(registers), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(BAND_ROWS):
        keys = mixed(keys ^ parts[:, :, i]) + np.uint64(i)
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of register lines, and its standard deviation at 0.5 or more."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    by_chance = CHANCE * 2.0 ** (BUCKET_BITS - MANTISSA + 1) * 4 * ratio / (1 + ratio) ** 2
    found = np.clip((same - by_chance) / np.maximum(used, 1), 0, 1)
    return found, 0.5 / np.sqrt(np.maximum(used, 1))


SIGNATURE = StructType([
    StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("set", BinaryType()),
    StructField("bands", ArrayType(LongType()))])
MEMBER = StructType([StructField("rep", LongType()), StructField("registers", BinaryType()),
                     StructField("hashes", BinaryType())])


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, set (128 bits of the set; null if empty) and band keys of every row."""

    def sign(batches):
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                n = high - low
                rows, hashes = shingles(data, offsets, width)
                sizes = np.bincount(rows, minlength=n)
                sums = np.zeros((n, 2), dtype=np.uint64)
                for i, seed in enumerate((0x51ED270B, 0xA0761D65)):
                    np.add.at(sums[:, i], rows, mixed(hashes ^ np.uint64(seed)))
                digest = mixed(sums + sizes[:, None].astype(np.uint64))
                ids = _binaries(digest, np.full(n, 16))
                keys = bands_of(registers_of(rows, hashes, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                empty = pa.array(sizes == 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, n), pa.array(sizes.astype(np.int64)),
                    pc.if_else(empty, pa.scalar(None, pa.binary()), ids),
                    pc.if_else(empty, pa.scalar(None, lists.type), lists)], names=SIGNATURE.names)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, SIGNATURE)


def members(texts: DataFrame, width: int) -> DataFrame:
    """(rep, registers, hashes) of rows (rep, text): what the estimate and the verification need."""

    def build(batches):
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                rows, hashes = shingles(data, offsets, width)
                lines = registers_of(rows, hashes, high - low)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), _binaries(lines, np.full(high - low, BUCKETS * 2)),
                    _binaries(hashes, np.bincount(rows, minlength=high - low) * 8)], names=MEMBER.names)

    return texts.select("rep", "text").mapInArrow(build, MEMBER)


def verified(pairs: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = member.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("hashes").alias("ha"))
    right = member.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("hashes").alias("hb"))

    def confirm(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lines = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, BUCKETS) for c in (2, 4)]
            sizes = [pc.binary_length(batch.column(c)).to_numpy() // 8 for c in (3, 5)]
            likely, sigma = estimate(*lines, *sizes)
            keep = np.zeros(n, bool)
            # Two sets can't reach the threshold where their sizes are too far apart.
            fit = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            for i in np.flatnonzero(fit & (likely >= percent / 100 - ESTIMATE_SIGMAS * sigma)):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 5))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"])

    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "ra", "ha", "rb", "hb").mapInArrow(confirm, "a bigint, b bigint")


def _listed(member: DataFrame) -> DataFrame:
    """(member, rep, label, n, h): the hashes of each member's full set, one a row."""

    def rows(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 8
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for low in range(0, batch.num_rows, 256):
                high = min(low + 256, batch.num_rows)
                which = np.repeat(np.arange(low, high), sizes[low:high])
                data = b"".join(batch.column(2).slice(low, high - low).to_pylist())
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(batch.column(3), at), pc.take(batch.column(0), at), pc.take(batch.column(1), at),
                     pa.array(sizes[which]), pa.array(np.frombuffer(data, np.int64)[:edges[high] - edges[low]])],
                    names=["member", "rep", "label", "n", "h"])

    named = member.select("rep", "label", "hashes", F.xxhash64("rep", "hashes").alias("member"))
    return named.mapInArrow(rows, "member long, rep long, label long, n long, h long")


def _size_class(n: Column) -> Column:
    """Grows with n, by one for every two hundredths."""
    return F.floor(F.log(n.cast("double")) * 50)


def pairs_apart(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, label, hashes) of different labels that can reach the threshold.

    Prefix filtering: with every set ordered from its rarest shingle, two sets
    that reach the threshold share a shingle within their first places, and
    what stands behind the places of the first shared one must suffice for the
    overlap. For a partner of its own size or larger only the first ninth (at
    80 percent) of a set's places can be the first shared one, for a smaller
    partner the first fifth: so pages of one template with enough of their own
    meet nobody, however many they are. At a shingle of many members, the sizes
    that a partner may have, given both places, are part of the key. No pair
    that reaches the threshold is lost, and at each shingle only members
    outside its largest label look for partners.
    """
    listed = stored(_listed(member), "member-shingles")
    common = stored(listed.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common-shingles")
    shared = stored(listed.join(common, "h"), "shared-shingles")
    places = Window.partitionBy("member").orderBy("df", "h")
    total = Window.partitionBy("member")
    # Shingles of one member alone come first, unlisted.
    placed = shared.withColumn("place", F.row_number().over(places) - 1 + F.col("n") - F.count("*").over(total))
    n, left = F.col("n"), F.col("n") - F.col("place")
    first = stored(placed.where(100 * F.col("place") <= (100 - percent) * n).select("h", "rep", "label", "n", "place"), "prefixes")
    hot = stored(first.groupBy("h", "label").agg(F.count("*").alias("members")).groupBy("h").agg(
        F.max(F.struct("members", "label"))["label"].alias("largest"), F.count("*").alias("labels"),
        F.sum("members").alias("members")).where("labels > 1")
        .select("h", "largest", (F.col("members") > HOT_MEMBERS).alias("hot")), "largest-labels")
    rows = stored(first.join(hot, "h"), "placed-prefixes")
    # Given a place, the size of a partner is at most this, in hundredths of the threshold's terms.
    most = F.floor(left * (100 + percent) / percent) - n
    own, none = _size_class(n), F.array(F.lit(0).cast("bigint"))

    def classes(low: Column, high: Column) -> Column:
        return F.explode(F.when(F.col("hot"), F.sequence(_size_class(low), _size_class(high))).otherwise(none))

    own = F.when(F.col("hot"), own).otherwise(0)
    smaller = rows.where(left * (100 + percent) >= 2 * percent * n).select(
        "h", F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), left.alias("left_a"),
        (F.col("label") == F.col("largest")).alias("common_a"), own.alias("class_a"),
        classes(n, F.least(most, F.floor(n * 100 / percent))).alias("class_b"))
    larger = rows.where(most * 100 >= percent * n).select(
        "h", F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), left.alias("left_b"),
        (F.col("label") == F.col("largest")).alias("common_b"), own.alias("class_b"),
        classes(F.ceil(n * percent / 100), F.greatest(F.least(most, n), F.ceil(n * percent / 100))).alias("class_a"))
    keys = ["h", "class_a", "class_b"]
    met = smaller.where("NOT common_a").join(larger, keys).unionByName(
        smaller.where("common_a").join(larger.where("NOT common_b"), keys))
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    met = met.where((F.col("label_a") != F.col("label_b")) & (F.col("n_a") <= F.col("n_b")) & enough
                    & (100 * F.col("n_a") >= percent * F.col("n_b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    signed = stored(signatures(docs, key, text, width), "signatures")
    known = signed.where("doc_id IS NOT NULL AND set IS NOT NULL")
    # Equal sets are one member, named by its smallest doc_id.
    reps = stored(known.groupBy("set").agg(F.min("doc_id").alias("rep")), "set-members")

    found = stored(signed.join(reps, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "document-members")
    # Rows with one doc_id and different texts are one document.
    several = stored(found.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
                     .where("a != z").select("doc_id", "a"), "ids-of-several")
    same_id = stored(found.join(several, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")), "same-ids")

    posts = known.select("set", F.xxhash64("set").alias("head"), F.explode("bands").alias("band"))
    shared = posts.groupBy("band").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low != high")
    postings = stored(
        stored(posts.select("band", "set").join(stored(shared.select("band"), "shared-bands"), "band").distinct(), "band-sets")
        .join(reps, "set").select("band", "rep").distinct(), "postings")

    needed = stored(postings.select("rep").distinct(), "members-needed")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text")).join(needed, "rep")
    member = stored(members(texts, width).distinct(), "members")

    # The centre of a band is the member that meets most others over all its bands.
    sizes = stored(postings.groupBy("band").agg(F.count("*").alias("n")), "band-sizes")
    weights = stored(postings.join(sizes, "band").groupBy("rep").agg(F.sum("n").alias("weight")), "weights")
    weighed = stored(postings.join(weights, "rep"), "weighed")
    centres = stored(weighed.groupBy("band").agg(F.max(F.struct("weight", "rep"))["rep"].alias("centre")), "centres")
    star = weighed.join(centres, "band").where("rep != centre").select(
        F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    star = stored(star, "star-pairs")
    edges = stored(verified(star, member, percent), "star-links").union(same_id)
    labels = components(edges)

    # Members that share a band and are still apart: compared with each other, whoever they are.
    marked = stored(weighed.select("band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("band", "rep", F.coalesce("label", "rep").alias("label")), "marked")
    open_bands = stored(marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                        .where("low != high").select("band"), "open-bands")
    rest = stored(marked.join(open_bands, "band").select("rep", "label").distinct(), "members-apart")
    apart = stored(pairs_apart(member.join(rest, "rep").select("rep", "label", "hashes"), percent)
                   .join(star, ["a", "b"], "left_anti"), "pairs-apart")
    edges = edges.union(stored(verified(apart, member, percent), "links-apart"))
    labels = components(edges)

    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return (found.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
