"""The registered query of each operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symgrove.llm import (
    class_lm, conversations, exact_dedup, langid, merkle, mixing, near_dups, packing, token_counts, token_files, topk,
    toxicity, url_filter)
from symgrove.llm.sql import OP10_SQL, OP11_SQL, OP13_SQL
from symgrove.llm.words import fold
from symgrove.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Verdict, host and path of the rules.
URL_RULES = """VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS rules(verdict, host, path)")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
WITH rules(verdict, host, path) AS ({URL_RULES}),
after AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM after),
fits AS (
  SELECT n, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits USING (n)
"""


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(_table(spark, sf_dir, "embeddings"), is_query="id % 50 = 0", k=5, scale=256.0)
    return found.select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH known AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM known q JOIN known c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")
    files = token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), end_id=0)
    read = token_files.read_token_files(spark, path, files, docs.schema["doc_id"].dataType)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = class_lm.class_scores(docs, fold(F.col("doc_id"), 7) != 2)
    return scored.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), length=2048, end_id=1)
    return packing.digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def _fold_key(*parts: Column) -> Column:
    """Unsigned crc32 of the parts, joined by colons."""
    return F.crc32(F.concat_ws(":", *parts).cast("binary"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_hash(fields))
    rows = merkle.manifest(docs, carried={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"),
                         [(F.col("place"), F.col("n")), (F.col("tree_place"), F.col("trees"))])
    return rows.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left, by the crc32 of conversation and turn."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.col("kind")
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (_fold_key(*name) % 20).alias("kind"))
            .where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found, lines = conversations.repair(damaged(rows))
    # Turns of the rows that are left; a conversation that lost all of them stays in the result.
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    left = F.when(_fold_key(*name) % 20 != 0, F.col("turn"))
    every = rows.groupBy("conv_id").agg(conversations.gaps(left).alias("gaps"))
    repaired = found.join(conversations.digests(lines).withColumnRenamed("conv", "_conv"),
                          F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(repaired, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_url_filter": op1_url_filter, "op2_top_k": op2_top_k, "op3_language": op3_language, "op4_mix": op4_mix,
    "op5_exact_dedup": op5_exact_dedup, "op6_token_files": op6_token_files, "op7_toxicity": op7_toxicity,
    "op8_class_lm": op8_class_lm, "op9_pack": op9_pack, "op10_near_duplicates": op10_near_duplicates,
    "op11_merkle": op11_merkle, "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_top_k": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op10_near_duplicates": OP10_SQL,
           "op11_merkle": OP11_SQL,
           "op13_conversation_repair": OP13_SQL}
