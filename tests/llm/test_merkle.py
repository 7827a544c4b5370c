"""The Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from symgrove.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS])


def climb(nodes, at, fanout):
    """(siblings of node at, root, the steps that fold it back)."""
    siblings, steps = [], []
    while len(nodes) > 1:
        run = at // fanout * fanout
        group = nodes[run:run + fanout]
        siblings += group[:at - run] + group[at - run + 1:]
        steps.append((group, at - run))
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return siblings, nodes[0], steps


def brute(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    out, subroots = [], []
    for t in names:
        trees[t].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroots.append(climb([leaf(r) for r in trees[t]], 0, fanout)[1])
    for i, t in enumerate(names):
        leaves = [leaf(r) for r in trees[t]]
        above, root, upper = climb(subroots, i, fanout)
        for j, r in enumerate(trees[t]):
            siblings, subroot, lower = climb(leaves, j, fanout)
            key = r["doc_id"]
            changed = dict(r)
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf(changed)
            for group, place in lower + upper:
                node = digest(*group[:place], node, *group[place + 1:])
            out.append((key, leaves[j], subroot, root, digest(*siblings, *above), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("n, fanout, span", [(1, 2, 2), (2, 2, 2), (9, 2, 2), (37, 2, 4), (64, 2, 2), (65, 2, 2), (200, 3, 3), (83, 8, 8)])
def test_equals_a_plain_tree(spark, make_docs, monkeypatch, n, fanout, span):
    draw = random.Random(n)
    rows = [{"doc_id": i * 7 % 1001, "text": draw.choice(["Ab", "x", "", None, "É ü"]) , "lang": draw.choice(["en", "de", "é", None, "zz"]),
             "source": draw.choice(["s", None]), "n_chars": draw.choice([1, None]), "size": "", "key": None, "label": 0,
             "score": 0.0, "kept": None} for i in range(n)]
    docs = make_docs(rows).repartition(3)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_hash(fields))
    got = merkle.manifest(docs, carried={"tampered": tampered}, fanout=fanout, span=span)
    steps = [(F.col("place"), F.col("n")), (F.col("tree_place"), F.col("trees"))]
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("p"),
                     merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"), steps, fanout).alias("folded"),
                     (merkle.fold(F.col("leaf"), F.col("siblings"), steps, fanout) == F.col("root")).alias("whole")).collect()
    assert all(r.whole for r in got)
    assert order((*r[:6], r.folded == r.root) for r in got) == order(brute(rows, fanout))


def test_odd_rows(spark, make_docs, odd_rows):
    got = merkle.manifest(make_docs(odd_rows), fanout=2, span=2)
    assert order((r.doc_id, r.leaf, r.subroot, r.root) for r in got.collect()) == order(x[:4] for x in brute(odd_rows, 2))
    assert merkle.manifest(make_docs([])).count() == 0
    twice = make_docs([odd_rows[3]] * 50)
    assert merkle.manifest(twice, fanout=2, span=4).select("place").distinct().count() == 50


def test_bytes_that_are_no_utf8(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows[:4]).withColumn("text", F.unhex(F.lit("61FF62")).cast("string"))
    got = merkle.manifest(docs).select("leaf").distinct().collect()
    parts = [b"1:0", b"4:src0", b"2:en", b"1:0", b"3:a\xffb"]
    assert hashlib.sha256(b"".join(parts)).hexdigest() in {r.leaf for r in got}


def test_query_on_whole_documents(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_merkle(spark, sf).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert order(map(tuple, got)) == order(brute(rows, 8))
