"""Top-k search, language identification and the class language model."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrove.llm import class_lm, langid, queries, topk
from symgrove.llm.tables import stored
from symgrove.llm.words import fold


def brute_top_k(rows, k, scale=256.0):
    """rows: (id, vector); every query against every other id."""
    known = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in known if i % 50 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in known if p == q for i, b in known if i != q)[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


def got_top_k(df):
    rows = df.collect()
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_top_k_of_embeddings(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op2_top_k(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert got_top_k(got) == brute_top_k(rows, 5)


def test_top_k_ties_repeats_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 3)
    draw = np.random.default_rng(0)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 9) / 256]) for i in range(620)]       # many ties
    rows += [(50, rows[50][1]), (50, [0.0] * 9), (51, rows[51][1]), (51, rows[51][1]), (700, None), (701, [1.0, None]), (702, [float("nan")] * 9),
             (703, [float("inf")] * 9), (None, [1.0] * 9), (704, []), (705, [0.5]), (706, [1e6] * 20), (-50, [-1e6] * 9)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k in (1, 5, 1000):
        assert got_top_k(topk.top_k(df, "id % 50 = 0", k=k)) == brute_top_k(rows, k)
    assert topk.top_k(df.where("vec_id = 100"), "id % 50 = 0").count() == 0
    assert topk.top_k(df.where("false"), "id % 50 = 0").count() == 0


def test_queries_go_only_to_shards_that_can_win(spark, monkeypatch):
    """Groups of alike vectors: most shards are never searched for most queries, and results stay exact."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    draw = np.random.default_rng(4)
    centres = np.repeat(draw.choice([-1.0, 1.0], size=(12, 4)) * draw.uniform(0.5, 2, size=(12, 1)), 8, axis=1)
    rows = [(i, [float(x) for x in centres[i % 12] + draw.normal(size=32) * 0.05]) for i in range(1300)]
    rows += [(2000 + i, v[:8 + i % 20]) for i, (_, v) in enumerate(rows[:150])]        # shorter ones among them
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert got_top_k(topk.top_k(df, "id % 50 = 0")) == brute_top_k([(r["vec_id"], r["embedding"]) for r in df.collect()], 5)


def test_bounds_hold_and_spare_products():
    draw = np.random.default_rng(1)
    centres = np.repeat(draw.normal(size=(20, 16)) * 200, 4, axis=1)      # neighbouring components go together
    x = (centres[draw.integers(0, 20, 3000)] + draw.normal(size=(3000, 64)) * 10).astype(np.int64)
    q = x[:50]
    for segments in topk.SEGMENTS:
        bound = topk.statistics(q, segments) @ topk.statistics(x, segments).T
        assert (bound >= q @ x.T - 1e-6).all()
    best = topk._Best(50, 5)
    exact = topk.search_block((np.arange(50), q), (np.arange(3000), x), best)
    assert exact < 50 * 3000 / 4
    products = q @ x.T
    products[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    assert (best.scores.reshape(50, 5) == np.sort(products, axis=1)[:, ::-1][:, :5]).all()


def test_language_of_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op3_language(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off_and_odd_rows(spark, make_docs, odd_rows):
    data = [(i, t, g) for i, (t, g) in enumerate([("the thing with three thorns", "en"), ("this then that there", "en"),
            ("der schnee schmilzt schnell", "de"), ("schule schaf schiff", "de"), ("nothing", None), (None, "fr"), ("12 34", "xx")] * 3)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert {"en", "de"} <= set(model.languages)
    tests = spark.createDataFrame([("then", "en"), ("thrift thoth", "en"), ("schnurschaf", "de"), ("SCHNEE, schnee!", "de"), ("12 — !", "und"),
                                   ("", "und"), (None, "und")], "text string, want string")
    for r in langid.predict(tests, model).collect():
        assert r["lang_pred"] == r["want"], r
        assert (r["score"] == 0) == (r["want"] == "und")
    odd = langid.predict(make_docs(odd_rows), model)
    assert odd.count() == len(odd_rows) and odd.columns[-2:] == ["lang_pred", "score"]
    assert langid.predict(make_docs([]), model).count() == 0
    nothing = langid.fit(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}


def plain_language(data, texts):
    """(language, score) of texts by plain loops; data: (text, lang)."""
    def parts(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    def grams(word, length):
        marked = f"^{word}$" if length > 1 else word
        return [marked[i:i + length] for i in range(len(marked) - length + 1)] or [marked]

    counts = Counter((w, lang) for t, lang in set(data) for w in parts(t))
    languages = sorted({lang for _, lang in counts})
    pieces = Counter((g, lang) for w, lang in counts for n in langid.LENGTHS for g in grams(w, n))

    def logs(table):
        names, totals = {n for n, _ in table}, Counter()
        for (_, lang), n in table.items():
            totals[lang] += n
        return {n: [math.log((table[n, x] + langid.ALPHA) / (totals[x] + langid.ALPHA * len(names))) for x in languages] for n in names}

    words, known = logs(counts), logs(pieces)
    for text in texts:
        sums = [0.0] * len(languages)
        for w in parts(text):
            found = words.get(w)
            for n in langid.LENGTHS if found is None else ():
                some = [known[g] for g in grams(w, n) if g in known]
                if 2 * len(some) >= len(grams(w, n)):
                    found = [sum(x) / len(some) for x in zip(*some)]
                    break
            sums = [a + b for a, b in zip(sums, found or [0.0] * len(languages))]
        best = max(range(len(languages)), key=lambda i: (sums[i], -i))
        yield (languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)) if parts(text) else ("und", 0.0)


def test_codes_of_any_size_are_packed():
    for codes in ([], [0], [1, (1 << 24) - 1, 7], [1 << 24, 5, (1 << 32) - 1]):
        assert class_lm._unpack(class_lm._pack(np.array(codes, dtype=np.int64))).tolist() == codes


def test_language_scores_equal_plain_loops(spark, sf):
    docs = [(r["text"], r["lang"], r["doc_id"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    taught = [(t, lang) for t, lang, i in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    extra = ["", "12 !", "É", "日本", "a", "xq zzz thorn-bush don't", "ÀÉÎ straße"]
    model = langid.fit(spark.createDataFrame(taught, "text string, lang string").repartition(3))
    texts = [t for t, _, _ in docs] + extra
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()
    for r, (lang, score) in zip(sorted(got, key=lambda r: r["i"]), plain_language(taught, texts)):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-6, abs=1e-9), r["text"][:80]


def test_rare_language_with_words_of_its_own(spark):
    """Large languages with many words leave a rare one's words known, seen once or not."""
    data = [(f"the {' '.join(f'w{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26 % 26)}' for j in range(26))}", "en") for i in range(600)]
    data += [("kotek pies zajac", "pl"), ("mysz kotek", "pl")]
    model = langid.fit(spark.createDataFrame(data, "text string, lang string"))
    tests = spark.createDataFrame([("zajac", "pl"), ("mysz", "pl"), ("the waab", "en")], "text string, want string")
    assert all(r["lang_pred"] == r["want"] for r in langid.predict(tests, model).collect())


def tokens(text):
    return (text or "").encode().lower().split() + [class_lm.END]


def check_base(rows):
    """rows: (text, train, result)."""
    count = Counter(t for text, train, _ in rows if train for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for text, train, r in rows:
        all_ = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(all_), sum(count[t] > 0 for t in all_), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in all_), rel=1e-9, abs=1e-9)
        assert r["score"] < 0 or n == 0
    return count


def test_class_model_beats_its_base_on_held_out_texts(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = queries.op8_class_lm(spark, folder)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    check_base([(r["text"], not r["held_out"], r) for r in rows])
    held = [r for r in rows if r["held_out"]]
    total = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / total > sum(r["base_score"] for r in held) / total + 0.1


def test_class_model_of_odd_rows(make_docs, odd_rows):
    from pyspark.sql import functions as F

    docs = make_docs(odd_rows)
    found = class_lm.class_scores(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    by_text = defaultdict(list)
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        by_text[r["n_tokens"], r["train"]].append(r)
    check_base([(o["text"], o["doc_id"] is None or o["doc_id"] % 2 == 0,
                 next(r for r in rows if r["key"] == o["doc_id"] and r["n_tokens"] == len(tokens(o["text"])))) for o in odd_rows])
    assert class_lm.class_scores(make_docs([]), F.lit(True)).count() == 0
    untrained = class_lm.class_scores(docs, F.lit(False)).collect()
    assert len(untrained) == len(odd_rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untrained)


def test_probabilities_sum_to_one(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.5, 30) % 300) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    chunks = class_lm.chunked(docs, "doc_id", "text", F.lit(True)).cache()
    counts = class_lm.word_counts(chunks)
    model = class_lm.fit(chunks, counts)
    rows = counts.collect()
    kind = model.class_of[class_lm.units_of([bytes(r["word"]) for r in rows], model.top)]
    c = np.array([r["c"] for r in rows])
    for before in range(class_lm.CLASSES):
        p = 10 ** model.transition[before]
        known = p[kind] * (c + 1) / (model.class_tokens[kind] + model.class_types[kind] + 1)
        unknown = (p / (model.class_tokens + model.class_types + 1)).sum()
        assert known.sum() + unknown == pytest.approx(1, abs=1e-9)
    assert ((c + 1) / (model.tokens + model.types + 1)).sum() + 1 / (model.tokens + model.types + 1) == pytest.approx(1)


def test_exchange_finds_alternating_classes():
    draw = np.random.default_rng(4)
    nouns, verbs = np.arange(1, 21), np.arange(21, 41)
    table = np.zeros((60, 60))
    table[np.ix_(nouns, verbs)] = draw.integers(1, 9, (20, 20))
    table[np.ix_(verbs, nouns)] = draw.integers(1, 9, (20, 20))
    of = class_lm.exchange(table, classes=7, rounds=20)
    assert not set(of[nouns]) & set(of[verbs]) and of[0] == 0


def test_words_beyond_the_top_are_clustered_themselves(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(3)
    # Nouns and verbs alternate and all end alike; 640 of each are frequent, twenty of each rare.
    nouns, verbs = ([f"{kind}{i:03d}xyz" for i in range(660)] for kind in "nv")
    share = np.array([2.0] * 520 + [1.0] * 120 + [0.01] * 20)
    texts = [" ".join(w for pair in zip(draw.choice(nouns, 10, p=share / share.sum()), draw.choice(verbs, 10, p=share / share.sum())) for w in pair)
             for _ in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    chunks = class_lm.chunked(docs, "doc_id", "text", F.col("doc_id") % 5 != 0).cache()
    counts = class_lm.word_counts(chunks)
    model = class_lm.fit(chunks, counts)
    known = {bytes(r["word"]).decode(): (r["c"], r["class"]) for r in model.known.collect()}
    trained = Counter(t for i, text in enumerate(texts) if i % 5 for t in text.split())
    assert {w: c for w, (c, _) in known.items() if w != "\n"} == trained
    frequent = {w for w, c in trained.items() if c >= class_lm.LEAST}
    assert len(frequent) > 1200 > class_lm.TOP_WORDS and {w for w, (_, k) in known.items() if k is not None} == frequent
    of = [{known[w][1] for w in frequent if w[0] == kind} for kind in "nv"]
    assert not of[0] & of[1]
    # Transitions and class counts come from the classes of all words, and probabilities sum to one.
    assert model.class_tokens.sum() == sum(c for c, _ in known.values()) == model.tokens
    kind = {w: k for w, (_, k) in known.items()}
    pool = int(model.class_of[class_lm.units_of([b"n659xyz"], {})[0]])
    want = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for i, text in enumerate(texts):
        if i % 5:
            path = [0, *[pool if kind.get(w) is None else kind[w] for w in text.split()], 0]
            np.add.at(want, (path[:-1], path[1:]), 1)
    assert (class_lm.class_bigrams(model.told) == want).all()
    scored = class_lm.score(model).collect()
    assert len(scored) == len(texts)
    held = [r for r in scored if not r["train"]]
    assert sum(r["score"] - r["base_score"] for r in held) > 0.2 * sum(r["n_tokens"] for r in held)


def test_rare_language_is_learned_beside_large_ones(spark):
    data = [(i, f"the thing number n{i} with three thorns", "en") for i in range(20_000)]
    data += [(20_000 + i, "this same copy again and again", "en") for i in range(5000)]
    data += [(30_000 + i, f"der schnee schmilzt schnell k{i}", "de") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(4)
    model = langid.fit(docs, sample_rows=100)
    assert model.languages == ["de", "en"]
    tests = spark.createDataFrame([("schnee schmilzt", "de"), ("three thorns", "en")], "text string, want string")
    assert all(r["lang_pred"] == r["want"] for r in langid.predict(tests, model).collect())
    # All of the rare language, about LANG_ROWS of the other.
    words = dict(zip(model.words.to_pylist(), model.word_logs))
    assert words["schnee"][0] > words["schnee"][1] and words["thorns"][1] > words["thorns"][0]


def test_score_of_a_text_by_a_plain_loop(spark, sf):
    """The model's own tables, applied token by token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    train = fold(F.col("doc_id"), 7) != 2
    chunks = stored(class_lm.chunked(docs, "doc_id", "text", train), "test-chunks")
    model = class_lm.fit(chunks, stored(class_lm.word_counts(chunks), "test-counts"))
    known = {bytes(r["word"]): (r["c"], r["class"]) for r in model.known.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def kind(word):
        given = known.get(word, (0, None))[1]
        return int(model.class_of[class_lm.units_of([word], {})[0]]) if given is None else given

    for r in class_lm.score(model).collect():
        before, total = 0, 0.0
        for word in tokens(texts[r["key"]]):
            c, k = known.get(word, (0, None))[0], kind(word)
            emission = (c + 1) / (model.class_tokens[k] + model.class_types[k] + 1)
            p = class_lm.MIX * 10 ** model.transition[before, k] * emission \
                + (1 - class_lm.MIX) * (c + 1) / (model.tokens + model.types + 1)
            total, before = total + math.log10(p), k
        assert r["score"] == pytest.approx(total, rel=1e-9, abs=1e-9)
