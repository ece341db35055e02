import zlib

import numpy as np
import pytest

from meshwright.llm import toxicity as X


def auc(scores, y):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in X.op5_toxicity_machine(spark, f"/root/testdata/{sf}").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    out = [(got[d].score, y) for d, y in labels if got[d].held_out]
    s, y = np.array([a for a, _ in out]), np.array([b for _, b in out])
    predicted = s >= 0.3
    assert auc(s, y) > 0.97
    assert (predicted & (y == 1)).sum() / max(1, predicted.sum()) > 0.9 and (predicted & (y == 1)).sum() / y.sum() > 0.85


def test_pairs_of_terms_count(spark):
    rng = np.random.default_rng(0)
    rows, y = [], []
    filler = [f"word{i}" for i in range(50)]
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        words = [*rng.choice(filler, 8), *(["insultish"] if a else []), *(["groupish"] if b else [])]
        rows.append(" ".join(words))
        y.append(float(a and b))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int"))
    one, other, both, none = X.make_scorer(model)(["insultish word1", "groupish word1", "insultish groupish word1", ""])
    assert both > 0.8 and max(one, other, none) < 0.2


def test_scores_equal_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"term{i}" for i in range(30)]
    terms = np.unique(np.array([h for w in words for h in X.term_hashes(w)], np.uint64).view(np.int64))
    model = X.Model(terms, -0.3, rng.normal(0, 1, len(terms)), rng.normal(0, 0.5, (len(terms), 4)))
    texts = [" ".join(rng.choice(words, 12)) for _ in range(20)] + ["", "Term1 term1 TERM1 other"]
    for text, got in zip(texts, X.make_scorer(model)(texts)):
        own = [i for i, h in enumerate(terms) if h in set(X.text_terms(text).view(np.int64).tolist())]
        s = model.bias + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(own) for j in own[:k])
        assert abs(got - 1 / (1 + np.exp(-s))) < 1e-9


def test_terms_that_matter_only_in_pairs(spark):
    # label 1 where both or none of two words are there: neither alone says anything, and a linear model can't tell
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(40)]
    held = rng.random((4000, 2)) < 0.5
    rows = [" ".join([*rng.choice(filler, 6), *(["insultish"] if a else []), *(["groupish"] if b else [])]) for a, b in held]
    y = [int(a == b) for a, b in held]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    train = X.training_rows(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"), "doc_id", "text", "toxic", 20_000)
    told, others = X.choose_terms(train, 100)
    terms = np.union1d(told, others)
    own, labels = X.gather(train, terms)
    model, linear = X.fit_best(told, others, terms, own, labels), X.fit(terms, own, labels, factors=0)
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = lambda m: np.mean([(s > 0.5) == y[i] for i, s in zip(out, X.make_scorer(m)([rows[i] for i in out]))])
    assert right(model) > 0.95 and right(linear) < 0.6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "some text", 5), (3, "", 5), (4, "a " * 90_000, 5)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = X.score(docs, X.train(docs, labels)).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    assert X.score(docs.limit(0), X.train(docs, labels.limit(0))).collect() == []
    assert X.drop_toxic(docs, X.train(docs, labels.limit(0))).columns == docs.columns
