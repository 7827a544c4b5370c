"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrove.llm import exact_dedup, near_dups, queries
from symgrove.llm.tables import stored
from symgrove.llm.words import shingles, text_slices


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def set_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(data, width, percent):
    """{doc_id: (n_shingles, smallest linked id)} of rows (doc_id, text), every pair that shares a shingle compared."""
    sets = {d: set_of(t, width) for d, t in data}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for one in s:
            holders[one].append(d)
    common = defaultdict(int)
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


def got_near(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates_of_documents(spark, sf):
    folder = sf.replace("0.001", "0.01")
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op10_near_duplicates(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got_near(got) == brute(data, 4, 80)


def edited(words, share, draw):
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def test_near_duplicates_of_groups(spark):
    """Groups at every distance, whose members are often linked only through others."""
    draw = random.Random(4)
    data = []
    for n_words in (6, 12, 40, 150, 400):
        for share in (0.005, 0.02, 0.03, 0.04, 0.06):
            base = [f"b{draw.randrange(10**7)}" for _ in range(n_words)]
            data += [" ".join(edited(base, share, draw)) for _ in range(25)]
    passage = [f"p{i}" for i in range(60)]                    # shared by many, similar to none
    data += [" ".join(passage + [f"o{draw.randrange(10**7)}" for _ in range(draw.randrange(20, 60))]) for _ in range(150)]
    draw.shuffle(data)
    data = list(enumerate(data))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert got_near(near_dups.near_duplicates(df, width=3)) == brute(data, 3, 80)


def test_near_duplicates_of_odd_rows(make_docs, odd_rows):
    data = list(enumerate(r["text"] for r in odd_rows))
    docs = make_docs([{**r, "doc_id": i} for i, r in enumerate(odd_rows)])
    assert got_near(near_dups.near_duplicates(docs)) == brute(data, 5, 80)
    rows = near_dups.near_duplicates(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    nulls = [r for r in rows if r["doc_id"] is None]
    assert len(nulls) == 2 and all(r["kept"] and r["component_id"] is None for r in nulls)
    assert near_dups.near_duplicates(make_docs([])).count() == 0


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (9, a), (7, "x y")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dups.near_duplicates(df).collect()} == {(5, 3), (3, 3), (9, 3), (7, 7)}


def template_pages(spark, n, own):
    """Pages of one template: 100 common words, then own(i) words of their own."""
    common = " ".join(f"t{i}" for i in range(100))
    return [(i, common + "".join(f" o{i}x{j}" for j in range(own(i)))) for i in range(n)]


@pytest.mark.parametrize("own", [lambda i: 15, lambda i: (8, 24)[i % 2], lambda i: 13 + i % 12])
def test_pages_of_a_template_do_not_meet_in_pairs(spark, monkeypatch, own):
    """Pairs that candidates' search looks at grow with the pages, not with their square, and links stay right."""
    monkeypatch.setattr(near_dups, "HOT_MEMBERS", 50)
    met = []
    for n in (600, 1200):
        data = template_pages(spark, n, own)
        member = near_dups.members(spark.createDataFrame(data, "rep bigint, text string"), 4).withColumn("label", F.col("rep"))
        pairs = near_dups.pairs_apart(stored(member, "template-members"), 80).collect()
        linked = {(a, b) for a in range(n) for b in range(a + 1, n)
                  if 100 * 97 >= 80 * (97 + own(a) + own(b))} if n == 600 else set()
        assert linked <= {(r["a"], r["b"]) for r in pairs}
        met.append(len(pairs) - (n * (n - 2) // 8 if own(0) == 8 else 0))
    assert met[0] == met[1] == 0 or met[1] <= 0 or met[1] <= 4 * met[0] + 100


def test_template_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT_MEMBERS", 20)
    data = template_pages(spark, 300, lambda i: (3, 9, 15, 22)[i % 4])
    data += [(1000 + i, " ".join(f"{'abcd'[(i + j) % 4]}{(i * j) % 9}" for j in range(40 + i % 9))) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    assert got_near(near_dups.near_duplicates(docs, width=4, percent=80)) == brute(data, 4, 80)


def test_registers_estimate_similarity():
    draw = np.random.default_rng(1)
    common, own = draw.integers(0, 2**63, 900, dtype=np.uint64), draw.integers(0, 2**63, (400, 100), dtype=np.uint64)
    lines = np.stack([near_dups.registers_of(np.zeros(1000, np.int64), np.concatenate([common, o]), 1)[0] for o in own])
    found, _ = near_dups.estimate(lines[::2], lines[1::2], np.full(200, 1000), np.full(200, 1000))
    assert abs(found.mean() - 900 / 1100) < 0.01 and found.std() < 0.04


def test_shingles_are_distinct_word_runs():
    import pyarrow as pa

    texts = ["a b c a b c a", "A\tb\nC", "", "x", None, "a b"]
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        rows, hashes = shingles(data, offsets, 3)
        assert np.bincount(rows, minlength=6).tolist() == [3, 1, 0, 1, 0, 1]
        assert len({hashes[rows == 0][i] for i in range(3)} & set(hashes[rows == 1])) == 1


def test_exact_duplicates(spark, sf):
    data = [(r["doc_id"], sha(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups = defaultdict(list)
    for d, s in data:
        groups[s].append(d)
    got = {r["doc_id"]: r for r in queries.op5_exact_dedup(spark, sf).collect()}
    assert len(got) == len(data)
    for d, s in data:
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(groups[s]), len(groups[s]), d == min(groups[s]), s)


def test_exact_duplicates_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    marked = exact_dedup.mark_duplicates(docs)
    rows = marked.collect()
    assert len(rows) == len(odd_rows) and set(docs.columns) <= set(marked.columns)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    rest = kept.collect()
    assert sorted(sha(r["text"]) for r in rest) == sorted({sha(r["text"]) for r in odd_rows})
    for r in rest:
        same = [o["doc_id"] for o in odd_rows if sha(o["text"]) == sha(r["text"]) and o["doc_id"] is not None]
        assert r["doc_id"] == min(same)
    assert exact_dedup.mark_duplicates(make_docs([])).count() == 0


def test_index_inserts_and_deletes(spark):
    def digests(*texts):
        return spark.createDataFrame([(k, sha(t)) for k, t in texts], "key bigint, digest string")

    index = exact_dedup.DigestIndex.empty(spark, 5000)
    index = index.insert(digests(*[(i, f"t{i % 3000}") for i in range(4000)]))
    live = {r["digest"]: (r["keep"], r["n"]) for r in index.live().collect()}
    assert live == {sha(f"t{i}"): (i, 2 if i < 1000 else 1) for i in range(3000)}
    index = index.delete(digests(*[(0, f"t{i}") for i in range(500, 3500)]))
    assert {r["digest"] for r in index.live().collect()} == {sha(f"t{i}") for i in range(500)}
    index = index.insert(digests((7, "t0"), (-1, "t1"), (9, "t900")))
    live = {r["digest"]: (r["keep"], r["n"]) for r in index.live().collect()}
    assert live[sha("t0")] == (0, 3) and live[sha("t1")] == (-1, 3) and live[sha("t900")] == (9, 1)


def test_a_living_index_splits_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 8)
    index, n = exact_dedup.DigestIndex.empty(spark, 8), 0
    for size in (5, 40, 300):
        rows = [(i, sha(f"text {i}")) for i in range(n, n + size)] + [(1000, sha("text 0"))]
        index, n = index.insert(spark.createDataFrame(rows, "key bigint, digest string")), n + size
        assert index.table.agg(F.max(F.size("digests"))).first()[0] <= 8 * 8
    assert index.buckets >= 300 // 16
    live = {r["digest"]: (r["keep"], r["n"]) for r in index.live().collect()}
    assert live == {sha(f"text {i}"): (i, 4 if i == 0 else 1) for i in range(n)}
    index = index.delete(spark.createDataFrame([(sha("text 7"),)], "digest string"))
    assert len(index.live().collect()) == n - 1


def test_cuckoo_filter_grows_and_forgets():
    keys = [sha(str(i)) for i in range(3000)]
    made = exact_dedup.CuckooFilter.sized(keys)
    assert all(made.holds(k) for k in keys)
    small = exact_dedup.CuckooFilter(16)
    assert not all(small.insert(k) for k in keys[:200])       # overflow is told
    again = exact_dedup.CuckooFilter.from_bytes(made.to_bytes())
    for k in keys[:1500]:
        again.delete(k)
    assert all(again.holds(k) for k in keys[1500:])
    assert sum(again.holds(k) for k in keys[:1500]) < 15
    assert sum(made.holds(sha(f"other{i}")) for i in range(5000)) < 20
