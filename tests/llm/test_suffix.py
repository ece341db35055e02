import hashlib
import random

import numpy as np
import pytest

from meshwright.llm import suffix as X


def brute(texts, length):
    """n_bytes, n_removed, n_spans, sha of the rest, for texts (bytes) in order."""
    seen, out = set(), []
    for t in texts:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                cover[i : i + length] = True
            seen.add(s)
        runs = int((cover[:-1] & ~np.r_[False, cover[:-2]]).sum()) if len(t) else 0
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


def repetitive(rng, n):
    """Texts over a small alphabet with passages, periods and copies."""
    letters = "abé"
    bits = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 40))) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.3:
            out.append(rng.choice(["ab", "a", "é"]) * rng.randint(0, 60))
        else:
            out.append("".join(rng.choice(bits) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(6)) for _ in range(rng.randint(0, 6))))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeats_among_contexts_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        length = rng.choice([3, 5, 8, 17])
        contexts = [t.encode() + rng.choice([b"", b"\0", b"\xff\0"]) for t in repetitive(rng, rng.randint(1, 12))]
        seen, want = set(), []
        for c in contexts:
            flags = []
            for i in range(max(len(c) - length + 1, 0)):
                flags.append(c[i : i + length] in seen)
                seen.add(c[i : i + length])
            want.append(flags)
        assert list(zip(*map(np.ndarray.tolist, X.repeats_among(contexts, length)))) == [(i, k) for i, flags in enumerate(want) for k, hit in enumerate(flags) if hit]


def test_runs_compress_repetitive_contexts():
    contexts = [b"a passage that is in all of these, and then %d" % i for i in range(200)]
    index = X.RunIndex(contexts, 10)
    assert len(index.head) < 0.3 * sum(map(len, contexts))
    assert (index.run_size > 0).all() and len(index.first_sample) == len(index.last_sample) == len(index.head)


def test_samples_at_run_ends_decide():
    rng = random.Random(5)
    passage = bytes(rng.randrange(97, 123) for _ in range(60))
    contexts = [bytes(rng.randrange(97, 123) for _ in range(20)) + passage + bytes([i]) for i in range(20)]
    index = X.RunIndex(contexts, 30)
    places, ranks, matched = index.stream()
    assert sorted(places.tolist()) == [i for a, z in zip(index.starts, index.ends) for i in range(a, z)]
    text = b"\0".join(contexts) + b"\0"
    by_rank = places[np.argsort(ranks)]
    for a, b, m in zip(by_rank, by_rank[1:], matched[np.argsort(ranks)][1:]):
        x, y = text[a : index.ends[np.searchsorted(index.ends, a)]], text[b : index.ends[np.searchsorted(index.ends, b)]]
        assert m == min(30, next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
    want = matched.tolist()
    for name in ("first_sample", "last_sample"):
        wrong = X.RunIndex(contexts, 30)
        setattr(wrong, name, np.roll(getattr(wrong, name), 1))
        assert wrong.stream()[2].tolist() != want


def test_cuts_of_crowded_anchors_hold_every_string_once(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("abcdefgh") for _ in range(14))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + core + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for crowded in (1, 2, 10):
        assert rows(X.repeat_facts(docs, length=16, kmer=6, crowded=crowded)) == sorted(((i, *f) for i, f in enumerate(brute([t.encode() for t in texts], 16))), key=str)


def test_anchors_govern_every_string_once():
    rng = random.Random(2)
    for _ in range(20):
        texts = [t.encode() for t in repetitive(rng, 8)]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = rng.choice([4, 9])
        _, begin, count, at = X.governed(data, starts, ends, length, 3)
        got = sorted(x for a, n in zip(begin, count) for x in range(a, a + n))
        assert got == [i for a, z in zip(starts, ends) for i in range(a, z - length + 1)]
        assert all(a + n - 1 <= p <= a + length - 3 for a, n, p in zip(begin, count, at))


@pytest.mark.parametrize("crowded", [1, 3, 4096])
def test_facts_equal_brute_force(spark, crowded):
    rng = random.Random(crowded)
    texts = repetitive(rng, 150)
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, doc int").repartition(5)
    got = rows(X.repeat_facts(docs, length=12, kmer=5, crowded=crowded))
    assert got == sorted(((i * 3, *f) for i, f in enumerate(brute([t.encode() for t in texts], 12))), key=str)


def test_odd_rows(spark):
    passage = "".join(chr(97 + i * i % 26) for i in range(150))
    docs = spark.createDataFrame([(5, passage, "a"), (5, passage, "b"), (None, passage[:120] + "é", "c"), (7, None, "d"), (8, "", "e"), (9, "short", "f"), (10, "short", "g"), (11, passage[20:] * 2, "h")], "doc_id long, text string, id string")
    got = {}
    for r in X.repeat_facts(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = brute([(passage[:120] + "é").encode(), passage.encode(), passage.encode(), (passage[20:] * 2).encode()], 100)
    assert [tuple(r)[1:] for r in got[None]] == want[:1] and sorted(tuple(r)[1:] for r in got[5]) == sorted(want[1:3]) and tuple(got[11][0])[1:] == want[3]
    assert got[7][0].n_bytes == got[8][0].n_bytes == 0 and got[10][0].n_removed == 0
    assert X.repeat_facts(docs.limit(0)).collect() == []


def test_drop_repeats_keeps_columns_and_drops_emptied_rows(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
    docs = spark.createDataFrame([(1, passage, "en", 150), (2, "é" + passage + "ü", "de", 152), (3, passage, "fr", 150), (4, "", "es", 0)], "doc_id long, text string, rest string, n_chars long")
    got = sorted(X.drop_repeats(docs).collect())
    assert X.drop_repeats(docs).columns == docs.columns
    assert [tuple(r) for r in got] == [(1, passage, "en", 150), (2, "éü", "de", 2), (4, "", "es", 0)]


def test_query_equals_brute_force(spark):
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in X.op4_run_length_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: f for (d, _), f in zip(texts, brute([t for _, t in texts], 100))}
