"""Token ids, packing and token files against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symgrove.llm import bpe, packing, queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)


def plain(text, end):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


PARTS = [" ", "\n", "\t", "a", "B", "é", "×", "÷", "1", ".", "'", "s", "t", "\xa0", " ", "日", "ß", "!", "\x1d",
         "\r", " the", "ll", "\u0085", "　", "😀", "_", "²"]


@pytest.mark.parametrize("parts", [PARTS, [*PARTS, "<|endoftext|>"]])
def test_pieces_give_the_tokenizers_ids(parts):
    draw = random.Random(3)
    for _ in range(60):
        texts = ["".join(draw.choices(parts, k=draw.randrange(25))) for _ in range(300)] + [None, ""]
        for low, high, ids, ends in bpe.encoded(pa.array(texts, pa.string()), PATH, 1):
            for i in range(low, high):
                assert ids[ends[i - low]:ends[i - low + 1]].tolist() == plain(texts[i], 1), repr(texts[i])


def check_pieces(pieces, wanted, length=2048):
    """Every id in one piece; windows filled in order without gaps; only the last is short."""
    streams = {}
    for p in pieces:
        streams.setdefault(p["sequence_id"], []).append(p)
    sizes = []
    for s in sorted(streams):
        at = 0
        for p in sorted(streams[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert sorted(streams) == list(range(len(streams)))
    assert all(n == length for n in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= length)
    assert sum(sizes) == sum(map(len, wanted))


def test_pack_whole_documents(spark, sf):
    docs = {r["doc_id"]: plain(r["text"], 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = queries.op9_pack(spark, sf).collect()
    check_pieces(pieces, docs.values())
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert by_doc.keys() == docs.keys()
    for doc, ids in docs.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at:at + p["length"]])
            at += p["length"]
        assert at == len(ids)


def test_pack_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(3)
    pieces = packing.pack(docs, PATH, length=64).collect()
    wanted = [plain(r["text"], 1) for r in odd_rows]
    check_pieces(pieces, wanted, 64)
    whole = packing.sequences(packing.pack(docs, PATH, length=64)).collect()
    stream = [i for r in sorted(whole, key=lambda r: r["sequence_id"]) for i in np.frombuffer(r["ids"], "<u4")]
    assert sorted(stream) == sorted(i for ids in wanted for i in ids)
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_token_files_round_trip(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, sf).collect()}
    at = 0
    for r in docs:
        ids = plain(r["text"], 0)
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_token_files_odd_rows(spark, make_docs, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 16)
    docs = make_docs(odd_rows)
    files = token_files.write_token_files(docs, str(tmp_path / "t"), PATH, length=32)
    read = token_files.read_token_files(spark, str(tmp_path / "t"), files, docs.schema["doc_id"].dataType)
    got = sorted(read.collect(), key=lambda r: r["start"])
    rows = sorted(odd_rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    assert [r["key"] for r in got] == [r["doc_id"] for r in rows]
    at = 0
    for g, r in zip(got, rows):
        assert np.frombuffer(g["ids"], "<u4").tolist() == plain(r["text"], 0) and g["start"] == at
        at += g["n_tokens"]
    for f in files.collect():
        one = token_files.TokenFile(str(tmp_path / "t" / f["tokens"]))
        ids, mask = zip(*[one.sequence(i) for i in range(f["n_sequences"])])
        assert sum(m.true_count for m in mask) == f["n_ids"] and all(len(x) == 32 for x in ids)
        assert not ids[0].flags.owndata                     # a view of the mapped file
    empty = token_files.write_token_files(make_docs([]), str(tmp_path / "e"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "e"), empty, docs.schema["doc_id"].dataType).count() == 0


def test_one_key_fills_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 14)
    data = [(None, f"text {i % 40} " + "word " * 20) for i in range(1500)] + [(i, "same words here " * 6) for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "t")
    files = token_files.write_token_files(docs, path, PATH)
    counts = [r["n_documents"] for r in files.collect()]
    assert sum(counts) == 3000 and max(counts) <= 4 * 3000 / len(counts)
    read = token_files.read_token_files(spark, path, files, docs.schema["doc_id"].dataType).orderBy("start").collect()
    keys = [r["key"] for r in read]
    assert keys == [None] * 1500 + list(range(1500))
    assert sorted(crc(np.frombuffer(r["ids"], "<u4")) for r in read) == sorted(crc(plain(t, 0)) for _, t in data)


def test_bytes_that_are_no_utf8_are_replaced(spark, tmp_path):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF6220C3")).cast("string").alias("text"))
    want = plain(b"a\xffb \xc3".decode(errors="replace"), 1)
    assert [np.frombuffer(p["ids"], "<u4").tolist() for p in packing.pack(docs, PATH, length=64).collect()] == [want] * 3
    files = token_files.write_token_files(docs, str(tmp_path / "t"), PATH, end_id=1)
    read = token_files.read_token_files(spark, str(tmp_path / "t"), files, docs.schema["doc_id"].dataType)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in read.collect()] == [want] * 3
