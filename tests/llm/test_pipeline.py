"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute, sha
from test_mixing import loop_targets
from test_tokens import check_pieces, plain

import corpus_pipeline
from symgrove.llm.tables import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(name, input rows, output rows, columns) of each stage over the folder."""
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {"columns": docs.columns, "folder": folder}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, folder), "stage")
        found[name] = before, docs.collect(), docs.columns
    return found


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    for name in ("toxicity", "exact dedup", "near dedup", "mixing"):
        assert stages[name][2] == stages["columns"] and stages[name][1]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after, _ = stages["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert len(after) == len(kept) and kept < {r["doc_id"] for r in before}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{stages['folder']}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert np.mean([d in kept for d in clean]) > 0.99
    rude = ("idiot", "moron", "scum", "worthless", "pathetic")
    gone = [r["doc_id"] not in kept for r in before if sum(w in r["text"].lower() for w in rude) >= 3]
    assert np.mean(gone) > 0.95


def test_exact_copies(stages):
    before, after, _ = stages["exact dedup"]
    first = {}
    for r in before:
        first[sha(r["text"])] = min(first.get(sha(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_near_copies(stages):
    before, after, _ = stages["near dedup"]
    linked = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in linked.items() if d == c)


def test_mix(stages):
    before, after, _ = stages["mixing"]
    size = lambda rows, s: sum(len(r["text"].encode().split()) for r in rows if r["source"] == s)
    sources = {r["source"] for r in before}
    target = loop_targets({s: size(before, s) for s in sources})
    for s in sources:
        assert abs(size(after, s) - target[s]) <= 0.02 * target[s] + 5
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_packing(stages):
    before, after, _ = stages["packing"]
    check_pieces(after, [plain(r["text"], 1) for r in before])


def test_run_repeats_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, stages["folder"]).collect()
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in stages["packing"][1])


def test_odd_rows_go_through_every_stage(spark, make_docs, odd_rows, tmp_path):
    """Nulls, repeated rows, long texts and clashing columns, and an empty table."""
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make_docs(odd_rows).withColumns({"toxicity_score": F.lit(0.9), "copies": F.lit(3)})
    columns, texts = docs.columns, {(r["doc_id"], r["text"]) for r in odd_rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd-stage")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts and {r["copies"] for r in rows} == {3}
        if name == "exact dedup":
            assert len({sha(r["text"]) for r in rows}) == len(rows) == len({sha(t) for _, t in texts})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_pieces(last, [plain(r["text"], 1) for r in docs.collect()])
    empty = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
