"""Targets and the cube method."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrove.llm import mixing, order, queries


def loop_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again; sizes: source -> size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, near):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["words"] == words and 0 <= r["taken"] <= 2 * words
        sizes[r["source"]] += words
        taken[r["source"]] += r["taken"]
    target = loop_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target.get(r["source"], 0.0), abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near(s, target[s]), (s, taken[s], target[s])


def test_documents_come_near_their_targets(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    got = queries.op4_mix(spark, folder)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.withColumnRenamed("size", "words").join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    check_mix(rows, lambda source, target: 0.01 * target + 5)
    again = {(r["doc_id"], r["taken"]) for r in queries.op4_mix(spark, folder).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_chunks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 40)
    draw = np.random.default_rng(5)
    data = [(i, "w " * int(draw.integers(0, 300)), "big" if i % 3 else f"s{i % 5}") for i in range(6000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    rows = mixing.mix(docs).withColumnRenamed("size", "words").collect()
    assert len(rows) == len(data)
    check_mix(rows, lambda source, target: 0.01 * target + 5)
    # Each level keeps the number of documents too, up to a few.
    big = [r for r in rows if r["source"] == "big"]
    assert abs(sum(r["copies"] for r in big) - len(big) * big[0]["target"] / big[0]["source_size"]) < 40


def test_flight_keeps_sums_and_probabilities():
    draw = np.random.default_rng(1)
    size = draw.integers(1, 500, 60).astype(float)
    part, count = draw.random(60), np.ones(60)
    mean = np.zeros(60)
    for seed in range(1500):
        out = mixing.flight(part, count, size, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(part.sum(), abs=1e-6)
        assert out @ size == pytest.approx(part @ size, abs=1e-4)
        mean += out / 1500
    assert np.abs(mean - part).max() < 0.06


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    mixed = mixing.mix(docs)
    assert set(docs.columns) <= set(mixed.columns)
    rows = mixed.withColumnRenamed("size", "words").collect()
    assert len(rows) == len(odd_rows)
    check_mix(rows, lambda source, target: 60_100)
    repeated = mixing.mixed_rows(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([{**odd_rows[0]}, {**odd_rows[1]}])).select("taken").distinct().collect()[0][0] == 0


def test_small_source_with_a_long_document_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    draw = np.random.default_rng(11)
    data = [(i, int(draw.integers(1, 60)), "hot") for i in range(3000)] + [(3000, 900, "hot")]
    data += [(4000 + i, int(draw.integers(1, 150)), f"small{i % 4}") for i in range(160)]
    data += [(5000 + i, 1100, f"small{i}") for i in range(4)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in data], "doc_id bigint, text string, source string")
    for share in (0.1, 1.1):        # the small sources take a part of their documents; the hot one does
        rows = mixing.mix(docs, share=share).withColumnRenamed("size", "words").collect()
        assert len(rows) == len(data)
        taken, target = defaultdict(int), {}
        for r in rows:
            assert 0 <= r["copies"] <= 2
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 3 for s in taken), {s: (taken[s], target[s]) for s in taken}


def test_rows_that_are_alike_are_dealt_by_count(spark, monkeypatch):
    """A third of a source without doc_id and of one size: its words come near the target all the same."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    data = [(None, "w " * 37, "a") for _ in range(3000)] + [(i, "w " * (1 + i % 90), "a") for i in range(6000)]
    data += [(9000 + i, "w " * (1 + i % 50), "b") for i in range(8000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(4)
    mixed = mixing.mix(docs)
    assert mixed.count() == len(data)
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"),
                                         F.max("copies").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 50 and r["most"] <= 2
    alike = {r["copies"] for r in mixed.where("doc_id IS NULL").select("copies").collect()}
    assert len(alike) == 2


def test_mixed_rows_keep_columns_of_any_name(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumns({"copies": F.lit(9), "alike": F.lit("a"), "whole": F.lit(1), "target": F.lit("t")})
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        assert (r["size"], r["copies"], r["alike"], r["whole"], r["target"]) == ("x", 9, "a", 1, "t")


def test_targets_of_many_sources(spark, monkeypatch):
    draw = np.random.default_rng(3)
    sizes = {f"s{i:04d}": int(draw.integers(0, 50) ** 3) for i in range(900)} | {None: 777}
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n bigint, source_size bigint").repartition(6)
    want = loop_targets(sizes)
    monkeypatch.setattr(mixing, "running_sums", lambda placed, columns: order.running_sums(placed, columns, slice_rows=37))
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)
    nothing = {r["source"]: r["target"] for r in mixing.source_targets(rows.withColumn("source_size", F.lit(0).cast("bigint"))).collect()}
    assert set(nothing.values()) == {0.0}
    assert mixing.source_targets(rows.where("false")).count() == 0
