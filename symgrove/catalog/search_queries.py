"""Registered queries S1-S11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.catalog import views as v
from symgrove.operators import search as s
from symgrove.operators.nodes import with_list_defaults
from symgrove.plans.storage import append_nodes, read_table
from symgrove.session import scratch_path


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return s.normalize_queries(v.search_queries(spark, sf))


def _routed(spark: SparkSession, sf: str, route: str) -> DataFrame:
    return s.route_queries(_normalized(spark, sf)).where(F.col("route") == route)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return s.symbol_docs(v.symbols(spark, sf))


def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf)


def route(spark: SparkSession, sf: str) -> DataFrame:
    return s.route_queries(_normalized(spark, sf)).select("qid", "route")


def short_search(spark: SparkSession, sf: str) -> DataFrame:
    short = _routed(spark, sf, "short")
    hits = s.short_search(short.select("q").distinct(), v.symbols(spark, sf))
    return short.join(hits, "q").select("qid", "node_id", "pos")


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select(
        "qid", F.array_join(s.query_tokens(F.col("q")), " ").alias("tokens"))


def trigram_index(spark: SparkSession, sf: str) -> DataFrame:
    return s.trigram_positions(_docs(spark, sf))


def trigram_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = _routed(spark, sf, "trigram")
    hits = s.match_trigrams(asked.select("q").distinct(), s.trigram_postings(s.spread_docs(_docs(spark, sf))))
    return asked.join(hits, "q").select("qid", "node_id")


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked, docs = _routed(spark, sf, "trigram"), _docs(spark, sf)
    return asked, s.rank_matches(asked.select("q").distinct(), s.trigram_postings(s.spread_docs(docs)),
                                 s.corpus_stats(docs))


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    asked, ranked = _ranked(spark, sf)
    return asked.join(ranked, "q").select("qid", "node_id", F.round("rank", 6).alias("rank"))


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    asked, ranked = _ranked(spark, sf)
    return asked.join(s.top_k(ranked, "q"), "q").select("qid", "node_id", "pos")


def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """S11 on a stored table: nodes and index appended in two batches, then searched."""
    path = scratch_path(spark, "search-table")
    symbols = v.symbols(spark, sf)
    rows = with_list_defaults(symbols.withColumns({
        c: F.lit("").alias(c) for c in ("source_code", "language") if c not in symbols.columns}))
    first = F.pmod(F.xxhash64("node_id"), F.lit(2)) == 0
    for batch, part in (("1", rows.where(first)), ("2", rows.where(~first))):
        append_nodes(part, path, batch)
    nodes, index = read_table(spark, path)
    return s.search_symbols(v.search_queries(spark, sf), nodes, index=index)


def attach_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return s.attach_metadata(top_k(spark, sf), v.symbols(spark, sf))


def format_hit(spark: SparkSession, sf: str) -> DataFrame:
    hits = s.search_symbols(v.search_queries(spark, sf), v.symbols(spark, sf), k=5)
    shown = s.format_hit(F.col("symbol_name"), F.col("node_type"), F.col("file_path"))
    return hits.select("qid", "node_id", shown.alias("shown"))


def search(spark: SparkSession, sf: str) -> DataFrame:
    return s.search_symbols(v.search_queries(spark, sf), v.symbols(spark, sf))


QUERIES = {
    "s_normalize": normalize,
    "s_route": route,
    "s_short_search": short_search,
    "s_tokenize": tokenize,
    "s_trigram_index": trigram_index,
    "s_trigram_match": trigram_match,
    "s_bm25": bm25,
    "s_top_k": top_k,
    "s_attach_metadata": attach_metadata,
    "s_format_hit": format_hit,
    "s_search_stored": search_stored,
    "s_search": search,
}

ORACLES = {
    "s_normalize": f"WITH {v.SQL_V5} SELECT qid, q FROM live",
    "s_route": f"""WITH {v.SQL_V5}
SELECT qid, CASE WHEN length(q) < 3 THEN 'short' ELSE 'trigram' END AS route FROM live""",
    "s_short_search": f"WITH {v.SQL_V5_MATCH} SELECT qid, node_id, pos FROM short_hits",
    "s_tokenize": f"""WITH {v.SQL_V5}
SELECT qid, array_to_string(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'),
                                        lambda x: length(x) >= 3), ' ') AS tokens FROM live""",
    "s_trigram_index": f"""WITH {v.SQL_V5_MATCH}
SELECT substr(s, CAST(i AS BIGINT) + 1, 3) AS tri, node_id, CAST(i AS INT) AS pos
FROM (SELECT *, unnest(range(0, CAST(dl AS BIGINT))) AS i FROM doc)""",
    "s_trigram_match": f"WITH {v.SQL_V5_MATCH} SELECT qid, node_id FROM ranked",
    "s_bm25": f"WITH {v.SQL_V5_MATCH} SELECT qid, node_id, round(rank, 6) AS rank FROM ranked",
    "s_top_k": f"WITH {v.SQL_V5_MATCH} SELECT qid, node_id, pos FROM best",
    "s_attach_metadata": f"""WITH {v.SQL_V5_MATCH}
SELECT node_id, qid, pos, symbol_name, node_type, file_path FROM best JOIN symbols USING (node_id)""",
    "s_format_hit": f"""WITH {v.SQL_V5_MATCH}
SELECT qid, node_id, symbol_name||' ['||upper(node_type)||']'||chr(10)||' ↳ '||file_path AS shown
FROM hits JOIN symbols USING (node_id) WHERE pos <= 5""",
    "s_search_stored": f"""WITH {v.SQL_V5_MATCH}
SELECT qid, pos, node_id, symbol_name, node_type, file_path FROM hits JOIN symbols USING (node_id)""",
    "s_search": f"""WITH {v.SQL_V5_MATCH}
SELECT qid, pos, node_id, symbol_name, node_type, file_path FROM hits JOIN symbols USING (node_id)""",
}
