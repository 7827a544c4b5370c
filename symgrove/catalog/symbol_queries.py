"""Registered queries B1-B6 and the whole extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symgrove.catalog import views as v
from symgrove.functions.ids import symbol_id
from symgrove.functions.paths import relative_to
from symgrove.operators import symbols as b


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    return b.scan_definitions(v.code_files(spark, sf)).select("rel_path", "tag", "symbol_name", "start_byte")


def extent(spark: SparkSession, sf: str) -> DataFrame:
    return b.scan_definitions(v.code_files(spark, sf)).select(
        "rel_path", "language", "symbol_name", "start_byte", "end_byte", "source_code")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    """Captures per part; some lack a name or a definition."""
    key = F.col("p_partkey")

    def capture(name: str | Column, text: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("key"),
                        text.alias("text"), key.alias("start"))

    tag = F.concat(F.lit("definition."), F.lower("p_type"))
    tag = F.when(key % 4 == 0, "definition.function").when(key % 4 == 1, "definition.struct") \
        .when(key % 4 == 2, "definition.constant").otherwise(tag)
    captures = F.array_compact(F.array(
        F.when(key % 3 == 0, capture("doc", F.col("p_brand"))),
        F.when(key % 5 != 0, capture(tag, F.col("p_type"))),
        F.when(key % 7 != 0, capture("name", F.col("p_name"))),
        F.when(key % 11 == 0, capture("definition.macro", F.col("p_brand")))))
    return v.table(spark, sf, "part").select(key.alias("match_id"), captures.alias("captures"))


def match_filter(spark: SparkSession, sf: str) -> DataFrame:
    return b.match_filter(_matches(spark, sf))


def classify_tag(spark: SparkSession, sf: str) -> DataFrame:
    return b.classify_tag(b.match_filter(_matches(spark, sf))).select(
        "match_id", "tag", "node_type")


def relative_path(spark: SparkSession, sf: str) -> DataFrame:
    root = F.concat(F.lit("/data/"), F.col("repo"), F.lit("/"))
    outside = F.octet_length("content") % 9 == 0
    full = F.when(outside, F.concat(F.lit("/other/"), F.col("rel_path"))) \
        .otherwise(F.concat(root, F.col("rel_path")))
    return v.files(spark, sf).select("repo", full.alias("path"),
                                     relative_to(full, root).alias("rel_path"))


def symbol_ids(spark: SparkSession, sf: str) -> DataFrame:
    doc = v.table(spark, sf, "documents")
    return doc.select("doc_id", symbol_id(F.col("source"), F.col("n_chars"), F.col("text"))
                      .alias("node_id"))


def extract(spark: SparkSession, sf: str) -> DataFrame:
    return b.symbol_nodes(v.code_files(spark, sf)).select(
        "node_id", "node_type", "file_path", "symbol_name", "source_code", "language")


QUERIES = {
    "b_definitions": definitions,
    "b_extent": extent,
    "b_match_filter": match_filter,
    "b_classify_tag": classify_tag,
    "b_relative_path": relative_path,
    "b_symbol_id": symbol_ids,
    "b_extract": extract,
}

_MATCH = """m AS (
  SELECT p_partkey AS match_id, p_partkey AS start_byte, p_name AS symbol_name,
         CASE WHEN p_partkey % 5 <> 0 THEN
           CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'constant'
                ELSE lower(p_type) END ELSE 'macro' END AS tag,
         CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS source_code
  FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 5 <> 0 OR p_partkey % 11 = 0))"""

ORACLES = {
    "b_definitions": f"WITH {v.SQL_V3} SELECT rel_path, tag, symbol_name, start_byte FROM expected",
    "b_extent": f"""WITH {v.SQL_V3}
SELECT rel_path, language, symbol_name, start_byte,
       CAST(start_byte + strlen(source_code) AS BIGINT) AS end_byte, source_code FROM expected""",
    "b_match_filter": f"WITH {_MATCH} SELECT match_id, tag, symbol_name, source_code, start_byte FROM m",
    "b_classify_tag": f"""WITH {_MATCH}
SELECT match_id, tag, CASE tag WHEN 'struct' THEN 'class' ELSE 'function' END AS node_type
FROM m WHERE tag IN ('function', 'macro', 'struct')""",
    "b_relative_path": f"""WITH {v.SQL_V2}
SELECT repo, CASE WHEN strlen(content) % 9 = 0 THEN '/other/'||rel_path
             ELSE '/data/'||repo||'/'||rel_path END AS path,
       CASE WHEN strlen(content) % 9 = 0 THEN '/other/'||rel_path ELSE rel_path END AS rel_path
FROM files""",
    "b_symbol_id": """WITH h AS (
  SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||
                      encode(source||':'||n_chars||':'||text)) AS h FROM documents)
SELECT doc_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
       substr('89ab', CAST(('0x'||substr(h,17,1))::INT % 4 + 1 AS INT), 1)||substr(h,18,3)||'-'||
       substr(h,21,12) AS node_id FROM h""",
    "b_extract": f"""WITH {v.SQL_V3}
SELECT node_id, node_type, rel_path AS file_path, symbol_name, source_code, language FROM v3_ids""",
}
