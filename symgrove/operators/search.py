"""Fuzzy symbol search for a whole table of queries.

Queries of three or more characters use trigrams. Each distinct query is
joined to the symbols on one trigram only, the one that occurs in the fewest
symbols; every token is then verified, and the rank computed, inside the row.
Symbols are never grouped by query, only the best k hits are. The query side
is measured first: within a fixed size it is broadcast and symbols are not
shuffled at all (``small``). Beyond it many queries share a trigram, so the
join is on up to KEY_CHARS characters around it; only rows that hold such a
key are shuffled, and the symbol side is never broadcast.
Shorter queries are LIKE patterns; the few shapes they can take are turned
into join keys, so they need no theta join either.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from symgrove.constants import BM25_B, BM25_K1, BM25_MIN_IDF, SEARCH_LIMIT
from symgrove.functions import text as t
from symgrove.operators.nodes import project_search
from symgrove.plans.manifest import Commit, read_folders
from symgrove.plans.sizing import BROADCAST_CHARS, fits_broadcast, gathered, hinted, stored

MIN_GRAM = 3
# Characters of a phrase, its rarest trigram among them, that many queries are joined on.
KEY_CHARS = 6
# Up to this many characters of query text, the trigrams and keys asked for are broadcast as filters.
FILTER_CHARS = 1 << 22


# --- S1, S2, S4: queries -------------------------------------------------------

def normalize_queries(queries: DataFrame) -> DataFrame:
    """(qid, q); empty queries are dropped."""
    return queries.select("qid", t.normalize(F.col("query")).alias("q")).where(F.col("q") != "")


def route_queries(normalized: DataFrame) -> DataFrame:
    """``short`` below three characters, else ``trigram``."""
    return normalized.withColumn(
        "route", F.when(F.length("q") < MIN_GRAM, "short").otherwise("trigram"))


def query_tokens(q: Column) -> Column:
    """Word tokens long enough to hold a trigram, in order."""
    return F.filter(t.words(q), lambda w: F.length(w) >= MIN_GRAM)


# --- S5: trigram index ---------------------------------------------------------

def symbol_docs(nodes: DataFrame) -> DataFrame:
    """(node_id, s, dl): folded name and its number of trigrams."""
    s = F.lower("symbol_name")
    return nodes.select("node_id", s.alias("s"),
                        F.greatest(F.length("symbol_name") - (MIN_GRAM - 1), F.lit(0)).alias("dl"))


def spread_docs(docs: DataFrame) -> DataFrame:
    """docs dealt over all cores: names of millions of symbols lie in a few small files, and each becomes many rows."""
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, "node_id")


def trigram_positions(docs: DataFrame) -> DataFrame:
    """(tri, node_id, pos), one row per trigram occurrence."""
    grams = F.posexplode_outer(t.ngrams(F.col("s"), MIN_GRAM))
    return docs.select("node_id", grams.alias("pos", "tri")).where(F.col("tri").isNotNull()) \
        .select("tri", "node_id", "pos")


def trigram_postings(docs: DataFrame) -> DataFrame:
    """(tri, node_id, s, dl), one row per distinct trigram of a symbol.

    Only positions are exploded, and a trigram counts where it occurs first:
    all of it is generated code, unlike arrays of trigrams.
    """
    places = F.sequence(F.lit(1), F.length("s") - (MIN_GRAM - 1))
    return (
        docs.where(F.length("s") >= MIN_GRAM)
        .select("node_id", "s", "dl", F.explode(places).alias("at"))
        .select(F.substring(F.col("s"), F.col("at"), F.lit(MIN_GRAM)).alias("tri"), "node_id", "s", "dl", "at")
        .where(F.instr(F.col("s"), F.col("tri")) == F.col("at")).drop("at")
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of symbols and mean trigram count."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


# Given on reading, so that the index of an empty table reads as empty.
_POSTINGS = "tri string, node_id string, s string, dl int, folder string, bucket int"
_GRAMS = "tri string, df bigint, folder string"
BUCKETS = 64
# Trigrams that are listed in the filter of a stored index's scan.
LISTED_TRIGRAMS = 1000


class Index(NamedTuple):
    """Postings by trigram, one row of corpus statistics and, if stored, trigram counts."""

    postings: DataFrame
    stats: DataFrame
    grams: DataFrame | None = None


def _bucket(tri: Column) -> Column:
    return F.pmod(F.hash(tri), F.lit(BUCKETS))


def write_index(docs: DataFrame, path: str, folder: str, salts: int = 8) -> None:
    """Store the postings of one batch of symbols, and how many symbols each trigram has.

    Symbols are dealt over ``salts`` tasks; each makes the postings of its
    own, so postings are not shuffled. They are laid out by a bucket of the
    trigram and sorted by trigram within files, so a search reads the buckets,
    and in them the parts, of its own trigrams.
    """
    postings = trigram_postings(docs.repartition(salts, "node_id"))
    (
        postings.withColumn("bucket", _bucket(F.col("tri")))
        .sortWithinPartitions("bucket", "tri")
        .write.partitionBy("bucket").parquet(f"{path}/postings/folder={folder}")
    )
    trigram_postings(spread_docs(docs)).groupBy("tri").agg(F.count("*").alias("df")).sortWithinPartitions("tri") \
        .write.parquet(f"{path}/grams/folder={folder}")


def read_index(spark: SparkSession, path: str, commits: Sequence[Commit]) -> Index:
    """The index that these commits make up; their facts are the corpus statistics."""
    n, total = sum(c.facts["rows"] for c in commits), sum(c.facts["sum_dl"] for c in commits)
    stats = spark.createDataFrame([(n, total / n if n else None)], "n_docs bigint, avgdl double")
    return Index(read_folders(spark, f"{path}/postings", commits, _POSTINGS).drop("folder"), stats,
                 read_folders(spark, f"{path}/grams", commits, _GRAMS).drop("folder"))


def _asked_only(postings: DataFrame, anchors: DataFrame, small: bool) -> DataFrame:
    """Of a stored index, the buckets and blocks of the anchors, as filters that reach its scans."""
    if "bucket" not in postings.columns or not small:
        return postings
    # At most LISTED_TRIGRAMS + 1 short strings.
    rows = anchors.select("tri", _bucket(F.col("tri")).alias("b")).distinct().limit(LISTED_TRIGRAMS + 1).collect()
    if len(rows) <= LISTED_TRIGRAMS:
        return postings.where(F.col("bucket").isin(sorted({r.b for r in rows}))
                              & F.col("tri").isin(sorted({r.tri for r in rows})))
    return postings


def _join_symbols(symbols: DataFrame, asked: DataFrame, key: str | list[str], small: bool, how: str = "inner") -> DataFrame:
    """Rows made of symbols with what is asked of them.

    Spark takes an exploded side for as small as the file it comes from, so
    without the hint it would broadcast all postings.
    """
    return symbols.join(F.broadcast(asked), key, how) if small else symbols.hint("merge").join(asked, key, how)


def _with_keys(asked: DataFrame) -> DataFrame:
    """asked (phrase, tri) with ``key``, the phrase's characters around tri, and where tri begins in it."""
    begin = F.greatest(F.lit(1), F.least(F.instr(F.col("phrase"), F.col("tri")), F.length("phrase") - (KEY_CHARS - 1)))
    return asked.withColumn("key", F.substring(F.col("phrase"), begin, F.lit(KEY_CHARS))) \
        .withColumn("shift", F.instr(F.col("key"), F.col("tri")) - 1)


def _keyed(postings: DataFrame, asked: DataFrame, filtered: bool) -> DataFrame:
    """(key, tri, node_id, s, dl) of the symbols that hold a key of ``asked``, one row per key and trigram.

    A posting yields what the symbol holds around its own trigram, each text
    where the symbol holds it first, if its trigram begins there as in a key
    of this shape. The same text may come from another trigram, around which
    other keys lie, so both together are the key.
    """
    shapes = asked.select("tri", "shift", F.length("key").alias("n")).distinct()
    first = F.instr(F.col("s"), F.col("tri"))
    again = F.call_function("locate", F.col("tri"), F.col("s"), first + 1)
    starts = F.sequence(F.lit(1), F.length("s") - (MIN_GRAM - 1))
    places = F.when(again == 0, F.array(first)).otherwise(
        F.filter(starts, lambda i: F.substring(F.col("s"), i, F.lit(MIN_GRAM)) == F.col("tri")))
    rows = (
        _join_symbols(postings, shapes, "tri", filtered)
        .select("tri", "node_id", "s", "dl", "n", "shift", F.explode(places).alias("at"))
        .withColumn("at", F.col("at") - F.col("shift"))
        .where((F.col("at") >= 1) & (F.col("at") + F.col("n") - 1 <= F.length("s")))
        .withColumn("key", F.substring(F.col("s"), F.col("at"), F.col("n")))
        .where((F.instr(F.col("s"), F.col("key")) == F.col("at")) & (F.instr(F.col("key"), F.col("tri")) == F.col("shift") + 1))
        .select("key", "tri", "node_id", "s", "dl")
    )
    return _join_symbols(rows, asked.select("key", "tri").distinct(), ["key", "tri"], True, "left_semi") if filtered else rows


def _candidates(postings: DataFrame, asked: DataFrame, small: bool, filtered: bool) -> DataFrame:
    """Symbols with each row of ``asked`` whose trigram, or key of a large set of queries, they hold."""
    if small:
        return _join_symbols(postings, asked, "tri", True)
    return _join_symbols(_keyed(postings, asked, filtered), asked, ["key", "tri"], False)


def _measured(texts: DataFrame, small: bool | None) -> tuple[bool, bool]:
    """Whether the query side is broadcast, and whether its trigrams and keys are."""
    small = fits_broadcast(texts, "q") if small is None else small
    return small, small or fits_broadcast(texts, "q", FILTER_CHARS)


# --- S6, S7: matching and rank ---------------------------------------------------

def phrase_anchors(phrases: DataFrame, postings: DataFrame, filtered: bool = False,
                   counts: DataFrame | None = None) -> DataFrame:
    """(phrase, tri, tri_df): the rarest trigram of each phrase, by stored counts if there are any.

    ``filtered`` says that the trigrams of all phrases may be broadcast.
    """
    grams = phrases.select(
        "phrase", F.explode(F.array_distinct(t.ngrams(F.col("phrase"), MIN_GRAM))).alias("tri"))
    counts = postings.select("tri", F.lit(1).alias("df")) if counts is None else counts
    freq = (
        _join_symbols(counts, grams.select("tri").distinct(), "tri", filtered, "left_semi")
        .groupBy("tri").agg(F.sum("df").alias("tri_df"))
    )
    rarity = F.struct(F.coalesce("tri_df", F.lit(0)).alias("tri_df"), "tri")
    return (
        _join_symbols(grams, freq, "tri", filtered, "left")  # one row per trigram asked for
        .groupBy("phrase").agg(F.min(rarity).alias("a"))
        .select("phrase", "a.tri", "a.tri_df")
    )


def _token_rows(texts: DataFrame) -> DataFrame:
    """(q, phrase, uses) of distinct normalised queries."""
    return texts.select("q", F.explode(query_tokens(F.col("q"))).alias("phrase")) \
        .groupBy("q", "phrase").agg(F.count("*").alias("uses"))


def document_frequency(anchors: DataFrame, postings: DataFrame,
                       small: bool = False, filtered: bool = False) -> DataFrame:
    """(phrase, df): symbols that contain each phrase."""
    asked = anchors.select("phrase", "tri") if small else _with_keys(anchors.select("phrase", "tri"))
    return (
        _candidates(postings, asked, small, filtered)
        .where(F.contains("s", "phrase")).groupBy("phrase").agg(F.count("*").alias("df"))
    )


def _asked_anchors(tokens: DataFrame, postings: DataFrame, small: bool, filtered: bool,
                   counts: DataFrame | None = None) -> DataFrame:
    """Anchors of the tokens; those of many are written once, as several joins read them."""
    anchors = phrase_anchors(tokens.select("phrase").distinct(), postings, filtered, counts)
    return anchors if small else stored(anchors, "search-anchors")


def _planned(phrases: DataFrame, small: bool) -> DataFrame:
    """Plans (q, phrase, tri, tokens), as they are joined to symbols: with keys, and written once, if they are many."""
    return phrases.drop("phrase") if small else stored(_with_keys(phrases).drop("phrase"), "search-plans")


def inverse_frequency(df: Column, n_docs: Column) -> Column:
    ratio = (n_docs - df + 0.5) / (df + 0.5)
    return F.when(ratio > 1, F.log(ratio)).otherwise(BM25_MIN_IDF)


def match_trigrams(texts: DataFrame, postings: DataFrame,
                   small: bool | None = None) -> DataFrame:
    """(q, node_id) where the symbol contains every token of the query."""
    small, filtered = _measured(texts, small)
    tokens = _token_rows(gathered(texts, small))
    anchors = _asked_anchors(tokens, postings, small, filtered)
    plans = _planned(
        tokens.join(hinted(anchors, small), "phrase").groupBy("q")
        .agg(F.min(F.struct("tri_df", "tri", "phrase")).alias("a"), F.collect_list("phrase").alias("tokens"))
        .select("q", "a.phrase", "a.tri", "tokens"), small)
    held = F.forall("tokens", lambda w: F.contains(F.col("s"), w))
    return _candidates(postings, plans, small, filtered).where(held).select("q", "node_id")


def rank_matches(texts: DataFrame, postings: DataFrame, stats: DataFrame,
                 small: bool | None = None, grams: DataFrame | None = None) -> DataFrame:
    """(q, node_id, rank) of every match; a lower rank is better.

    ``stats`` has one row. Its values enter as scalar subqueries. With stored
    ``grams`` the postings are scanned twice, to count phrases and to rank,
    both times only where the anchors are.
    """
    small, filtered = _measured(texts, small)
    n_docs, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
    tokens = _token_rows(gathered(texts, small))
    anchors = _asked_anchors(tokens, postings, small, filtered, grams)
    postings = _asked_only(postings, anchors, small)
    frequent = document_frequency(anchors, postings, small, filtered)
    phrases = anchors.join(hinted(frequent, small), "phrase", "left")
    token = F.struct("phrase", (F.col("uses") * inverse_frequency(F.col("df"), n_docs))
                     .alias("weight"))
    plans = _planned(
        tokens.join(hinted(phrases, small), "phrase").groupBy("q")
        .agg(F.min(F.struct("tri_df", "tri", "phrase")).alias("a"),
             F.sort_array(F.collect_list(token)).alias("tokens"),
             F.count("*").alias("n_tokens"), F.count("df").alias("n_found"))
        .where(F.col("n_found") == F.col("n_tokens"))
        .select("q", "a.phrase", "a.tri", "tokens"), small)
    held = F.forall("tokens", lambda w: F.contains(F.col("s"), w.phrase))
    length_norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))

    def score(token: Column) -> Column:
        tf = t.occurrences(F.col("s"), token.phrase)
        return token.weight * tf * (BM25_K1 + 1) / (tf + length_norm)

    rank = F.aggregate("tokens", F.lit(0.0), lambda acc, w: acc - score(w))
    return (
        _candidates(postings, plans, small, filtered).where(held).withColumn("avgdl", avgdl)
        .select("q", "node_id", rank.alias("rank"))
    )


# --- S3: short queries -------------------------------------------------------------

def _short_key(q: Column) -> Column:
    """Join key of a one- or two-character LIKE pattern within ``%q%``."""
    core = F.replace(q, F.lit("%"), F.lit(""))
    one, two = F.substring(core, 1, 1), F.substring(core, 2, 1)
    any_char = F.lit("_")
    return (
        F.when(F.length(core) == 0, F.lit("len0"))
        .when((F.length(core) == 1) & (one == any_char), F.lit("len1"))
        .when(F.length(core) == 1, F.concat(F.lit("char:"), one))
        .when((one == any_char) & (two == any_char), F.lit("len2"))
        .when(one == any_char, F.concat(F.lit("after:"), two))
        .when(two == any_char, F.concat(F.lit("before:"), one))
        .otherwise(F.concat(F.lit("pair:"), core))
    )


def _symbol_keys(names: DataFrame) -> DataFrame:
    """names (s, ...) with ``key``, one row per short key that a folded name satisfies.

    Only positions are exploded, and a key counts where the name holds it
    first: all of it is generated code, unlike arrays of keys.
    """
    s, at = F.col("s"), F.col("at")
    char, pair, last = F.substring(s, at, F.lit(1)), F.substring(s, at, F.lit(2)), F.length(s)
    first = F.instr(s, char) == at
    lengths = [F.when((at == 0) & (last >= n), f"len{n}") for n in range(3)]
    inner = at >= 1
    keys = F.array(
        *lengths,
        F.when(inner & first, F.concat(F.lit("char:"), char)),
        F.when(inner & (at < last) & (F.instr(s, pair) == at), F.concat(F.lit("pair:"), pair)),
        F.when((at >= 2) & (F.call_function("locate", char, s, F.lit(2)) == at), F.concat(F.lit("after:"), char)),
        F.when(inner & (at < last) & first, F.concat(F.lit("before:"), char)))
    return names.withColumn("at", F.explode(F.sequence(F.lit(0), last))) \
        .withColumn("key", F.explode(keys)).where(F.col("key").isNotNull()).drop("at")


def short_search(texts: DataFrame, nodes: DataFrame, k: int = SEARCH_LIMIT,
                 small: bool | None = None) -> DataFrame:
    """S3: (q, node_id, rank, pos), the k shortest names matching ``%q%``.

    Keys that are asked for are broadcast as a filter up to FILTER_CHARS, so
    that a name's other keys are not shuffled.
    """
    small, filtered = _measured(texts, small)
    keys = gathered(texts, small).select("q", _short_key(F.col("q")).alias("key"))
    names = spread_docs(nodes.select("node_id", "symbol_name")).select(
        "node_id", F.length("symbol_name").cast("double").alias("rank"), t.ascii_lower(F.col("symbol_name")).alias("s"))
    hits = _symbol_keys(names).drop("s").join(hinted(keys.select("key").distinct(), filtered), "key", "left_semi")
    return keys.join(top_k(hits, "key", k), "key").select("q", "node_id", "rank", "pos")


# --- S8-S11 ---------------------------------------------------------------------------

def top_k(hits: DataFrame, group: str, k: int = SEARCH_LIMIT) -> DataFrame:
    """The k best hits per group, ties by node_id, with their position.

    Spark cuts each map task to k rows per group before the shuffle, so a
    query that matches a third of all symbols costs no more than another.
    """
    w = W.partitionBy(group).orderBy("rank", "node_id")
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def attach_metadata(hits: DataFrame, nodes: DataFrame, small: bool = False) -> DataFrame:
    """Symbol name, type and path of hits already cut to k; never broadcasts the nodes, and ``small`` hits only."""
    found = project_search(nodes)
    return F.broadcast(hits).join(found, "node_id") if small else hits.join(found.hint("merge"), "node_id")


def format_hit(name: Column, kind: Column, path: Column) -> Column:
    """Two display lines, ``symbol [TYPE]`` and the path."""
    return F.concat(name, F.lit(" ["), F.upper(kind), F.lit("]\n ↳ "), path)


def text_hits(texts: DataFrame, nodes: DataFrame, k: int = SEARCH_LIMIT,
              index: Index | None = None, small: bool | None = None) -> DataFrame:
    """(q, pos, node_id) of distinct normalised texts with their route."""
    small = fits_broadcast(texts, "q") if small is None else small
    docs = symbol_docs(nodes)
    index = index or Index(trigram_postings(spread_docs(docs)), corpus_stats(docs))
    long_hits = top_k(rank_matches(
        texts.where("route = 'trigram'"), index.postings, index.stats, small, index.grams), "q", k)
    # Short texts are few kinds, also among very many queries: measured by themselves.
    short_hits = short_search(texts.where("route = 'short'"), nodes, k, small or None)
    return long_hits.select("q", "pos", "node_id").unionByName(
        short_hits.select("q", "pos", "node_id"))


def search_symbols(queries: DataFrame, nodes: DataFrame, k: int = SEARCH_LIMIT,
                   index: Index | None = None) -> DataFrame:
    """(qid, pos, node_id, symbol_name, node_type, file_path).

    Equal query texts are searched, and their hits joined to the nodes, once;
    the last join fans the finished rows out to the query ids. ``index`` is
    what :func:`read_index` returns; without it postings and statistics are
    derived from ``nodes``.
    """
    routed = route_queries(normalize_queries(queries))
    texts = routed.select("q", "route").distinct()
    small = fits_broadcast(texts, "q")
    # No more than BROADCAST_CHARS of hits either, at a row for every character of a text.
    few = small and fits_broadcast(texts, "q", BROADCAST_CHARS // max(k, 1))
    hits = attach_metadata(text_hits(texts, nodes, k, index, small), nodes, few)
    return routed.join(hits, "q").select(
        "qid", "pos", "node_id", "symbol_name", "node_type", "file_path")
