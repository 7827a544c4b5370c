"""Toxicity on held-out labels, and on awkward rows."""

from __future__ import annotations

import numpy as np

from symgrove.llm import queries, toxicity


def test_held_out_labels(spark, sf):
    folder = sf.replace("0.001", "0.1")
    got = queries.op7_toxicity(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    hit = rows.predicted[rows.toxic == 1].mean()
    wrong = rows.predicted[rows.toxic == 0].mean()
    assert wrong < 0.01, wrong
    assert hit > 0.75, hit
    order = rows.score.rank().to_numpy()
    positive = rows.toxic.to_numpy() == 1
    auc = (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.85, auc
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def labelled(n=300):
    """Texts of which a tenth hold rude words; every fifteenth label is wrong."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(n):
        words = [f"w{draw.integers(500)}" for _ in range(40)]
        bad = i % 10 == 0
        if bad:
            words[3:9:2] = ["rudeword", "nastyish", "vilething"]
        rows.append((i, " ".join(words), int(bad) ^ int(i % 15 == 1)))
    return rows


def test_odd_rows_and_noisy_labels(spark, make_docs, odd_rows):
    rows = labelled()
    known = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5, None), (99999, 1), (7, 0), (7, 0)],
                                   "doc_id bigint, toxic int")
    model = toxicity.fit(known, labels)
    assert {"=rudeword", "=nastyish", "=vilething"} & set(model.lexicon)
    again = toxicity.fit(known.repartition(5), labels.repartition(3))
    assert again.lexicon == model.lexicon and np.allclose(again.weights, model.weights)
    docs = make_docs(odd_rows + [{**odd_rows[3], "text": "You nastyish rudeword, vilething! A b c"}])
    got = toxicity.score(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"]
    result = got.collect()
    assert len(result) == len(odd_rows) + 1 and all(0 <= r["score"] <= 1 for r in result)
    assert [r["text"] for r in result if r["score"] >= toxicity.THRESHOLD] == ["You nastyish rudeword, vilething! A b c"]
    assert toxicity.score(make_docs([]), model).count() == 0
    nothing = toxicity.fit(known, labels.where("false"))
    assert {r["score"] for r in toxicity.score(known, nothing).collect()} == {toxicity.NO_LABELS}
    assert toxicity.score(known, toxicity.fit(known.where("false"), labels)).count() == len(rows)


def test_posterior_discounts_correlated_voters():
    draw = np.random.default_rng(3)
    truth = draw.random(4000) < 0.2
    independent = (draw.random((4000, 3)) < np.where(truth, 0.7, 0.05)[:, None]).astype(float)
    copied = np.repeat((draw.random((4000, 1)) < np.where(truth, 0.5, 0.2)[:, None]).astype(float), 8, axis=1)
    labels = np.where(draw.random(4000) < 0.1, ~truth, truth).astype(float)
    belief = toxicity.posterior(np.hstack([independent, copied]), labels)
    assert ((belief > 0.5) == truth).mean() > max((labels == truth).mean(), 0.93)


def plain_votes(text, lexicon):
    """The votes of one text by loops."""
    words = [w.lower() for w in text.encode().split()]
    features = [toxicity._features(w) & set(lexicon) for w in words]
    total, kinds = sum(map(bool, features)), len(set(words))
    distinct = len({w for w, f in zip(words, features) if f})
    raw = text.encode()
    letters = max(sum(chr(c).isalpha() and c < 128 for c in raw), 1)
    upper, shout = sum(65 <= c <= 90 for c in raw), sum(c in b"!?*#" for c in raw)
    patterns = [total >= 1, total >= 2, total >= 3, distinct >= 2, distinct >= 3, total > 0.005 * len(words),
                upper > 0.5 * letters, shout > 0.03 * max(len(raw), 1), kinds < 0.4 * len(words), len(words) < 20]
    fired = set().union(*features) if features else set()
    return [float(f in fired) for f in lexicon] + [float(x) for x in patterns]


def test_votes_and_scores_equal_plain_loops(spark, sf, odd_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"))
    model.lexicon = {**model.lexicon, **{f: len(model.lexicon) + i for i, f in enumerate(("=the", "word", "w1x", "=é"))
                                         if f not in model.lexicon}}
    model.weights = np.random.default_rng(0).normal(size=len(model.lexicon) + toxicity.PATTERNS)
    texts = [r["text"] or "" for r in docs.collect()] + [r["text"] or "" for r in odd_rows] + ["", "WORDS! wording é-the", "the " * 90]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3), model).collect()
    assert len(scored) == len(texts)
    for r in scored:
        logit = float(np.dot(plain_votes(r["text"], model.lexicon), model.weights)) + model.bias
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-6, r["text"][:80]
