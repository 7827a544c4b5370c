"""Token counts against the libraries themselves."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from symgrove.llm import queries, token_counts

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def counter(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return path, lambda text: len(model.encode(text))
    model = Tokenizer.from_file(path)
    return path, lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_odd_rows(spark, make_docs, odd_rows, monkeypatch, name, frequent):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    monkeypatch.setattr(token_counts, "LONGEST", 8)
    path, count = counter(name)
    rows = odd_rows + [{**odd_rows[3], "doc_id": 900 + i, "text": t} for i, t in enumerate([
        "a<|endoftext|>b <|endoftext|>", "<s> x </s>", "日本語 テキスト", "x" * 3000, "    a", "don't  stop\n\n\n now"])]
    got = token_counts.token_counts(make_docs(rows).repartition(4), path).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(make_docs([]), path).count() == 0


def test_bytes_that_are_no_utf8(spark, make_docs, odd_rows):
    path, count = counter(NAMES[0])
    docs = make_docs(odd_rows[:1]).withColumn("text", F.unhex(F.lit("61FF62C328")).cast("string"))
    row = token_counts.token_counts(docs, path).first()
    text = b"a\xffb\xc3(".decode(errors="replace")
    assert (row.n_bytes, row.n_tokens) == (len(text.encode()), count(text))


@pytest.mark.parametrize("sample", [20_000, 20])
def test_query_on_whole_documents(spark, sf, monkeypatch, sample):
    monkeypatch.setattr(token_counts, "SAMPLE_ROWS", sample)
    _, count = counter(NAMES[0])
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        text = r.text or ""
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(text.encode()), count(text), count(text) > 512)
