import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import weighted as G


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    top = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x | y) / top if top else 1.0


def edits(texts):
    out = []
    for i, t in enumerate(texts):
        q = len(t) // 4
        out.append(t[: len(t) - q] + texts[(i + 1) % len(texts)][:q])
    return out


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(5)
    texts = []
    for i in range(300):
        base = [rng.choice("the of and to".split()) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in G.edited_fingerprints(docs).collect()}
    edited = edits(texts)
    near = [got[i].near_edited - jaccard(t, edited[i]) for i, t in enumerate(texts)]
    after = [got[i].near_next - jaccard(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]
    for errors in (near, after):
        assert abs(sum(errors) / len(errors)) < 0.06  # the frequent words are the same in all texts, so errors go together
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1


def test_odd_rows(spark):
    rows = [(2, None, "a"), (1, "", "b"), (None, "null id", "c"), (5, "same text", "d"), (5, "same text", "e"), (5, "other text", "f"), (9, "é" * 9, "g"), (12, "word " * 50_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = G.edited_fingerprints(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].near_next == 1.0 and by[1][0].fingerprint == by[2][0].fingerprint == "0" * G.DIGITS * G.SAMPLES
    assert by[9][0].edited_sha256 == hashlib.sha256(("é" * 7 + "wo").encode()).hexdigest()
    assert by[None][0].n_chars == 7 and by[12][0].n_chars == 250_000
    assert len({(r.fingerprint, r.edited_sha256) for r in by[5]}) == 2
    assert G.edited_fingerprints(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").collect()]
    edited = edits([t for _, t in texts])
    got = {r.doc_id: r for r in G.op6_weighted_fingerprints(spark, f"/root/testdata/{sf}").collect()}
    prints = {}
    for (d, t), e in zip(texts, edited):
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert sum(got[d].near_edited > got[d].near_next for d, _ in texts) > 0.9 * len(texts)


def test_draws_follow_the_gamma_law_into_its_tails(spark):
    n = 300_000
    bits = F.xxhash64("id", F.lit(7))
    rows = spark.range(n).select(G.gamma_draw(bits, 32).alias("r"), G.gamma_draw(bits, 0, log=True).alias("c")).toPandas()
    for x in (rows.r.to_numpy(), np.exp(rows.c.to_numpy())):
        x = np.sort(x)
        assert np.abs(1 - (1 + x) * np.exp(-x) - (np.arange(n) + 0.5) / n).max() < 0.004
        assert x[0] < 0.008 and x[-1] > 13 and len(np.unique(x)) > 0.9 * n
    assert abs(np.corrcoef(rows.r, rows.c)[0, 1]) < 0.01


def test_long_texts_keep_the_error_of_64_samples(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" if rng.random() < 0.4 else f"v{i // 2}x{rng.randrange(3000)}" for _ in range(6000)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in G.edited_fingerprints(docs).collect()}
    assert G.SAMPLES >= 64 and all(len(r.fingerprint) == G.DIGITS * G.SAMPLES for r in got.values())
    errors = [got[i].near_edited - jaccard(t, e) for i, (t, e) in enumerate(zip(texts, edits(texts)))]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.09


def test_likeness_of_texts_with_many_terms(spark):
    # 20,000 terms each, generalised Jaccard similarity 0.4; the mean over 12 pairs has a standard error of 0.018
    from pyspark.sql import functions as F

    n, common = 20_000, round(20_000 * 0.8 / 1.4)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(n)), " ".join(f"w{k}x{i}" for i in range(n - common, 2 * n - common))) for k in range(12)]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(4)
    found = G.signatures(df, ["k"], ["a", "b"]).select(G.likeness(F.col("signature0"), F.col("signature1")).alias("x"))
    assert abs(found.agg(F.avg("x")).first()[0] - 0.4) < 0.055
