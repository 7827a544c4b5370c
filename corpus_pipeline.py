"""From raw documents to packed training sequences.

Each stage reads what its predecessor kept and returns the rows that stay, with
the columns of documents; the last returns pieces of packed sequences.

Defined results, beside those of the operators: a null, empty or blank text is
clean, counts as the empty text among exact copies, has no near copies, is of
size 0 in the mix, which takes it as often as its source's rate says, and packs
to its end mark. A null doc_id is no near copy of anything and stays there;
rows that share a doc_id and have different texts are one document for near
copies and rows of their own elsewhere. Texts of any length are read whole.
Columns beyond those of documents are carried by all stages but the last,
whatever their names. Of an empty table every stage gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.llm import exact_dedup, mixing, near_dups, packing, toxicity
from symgrove.llm.tables import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of a model learned from the labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = "toxicity_score" + "_" * max(map(len, docs.columns))     # a name that no column has
    return toxicity.score(docs, model, into=into).where(F.col(into) < toxicity.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 the one with the smallest id."""
    dropped = stored(near_dups.near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id"), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1))


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
# SQL can express neither the trained classifier nor the sampling and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
