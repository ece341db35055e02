import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm import retrieval as R
from meshwright.llm import tokens as T

PATH = T.vocabulary_path(T.VOCABULARY)
TOPICS = ["rivers lakes rain clouds", "engine wheel brake gear", "violin drum chord melody", "bread salt oven flour"]


def drawn(n, seed):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(TOPICS[i % 4].split() + ["the", "of", "and", f"w{r.integers(40)}"], int(r.integers(1, 60)))) for i in range(n)]


TEXTS = [*drawn(60, 3), "", None, "...", "x<|endoftext|>y", "中文  字\n", "same text", "same text", "long word " * 4000]


def ids_of(text):
    return [*T.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, limit):
    """Every id lies in one piece with the right ids, sequences are gapless, and only powers of two are short. Gives rows by sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids, end = ids_of(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids) and r.length > 0
            end += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : end], "<u4").tobytes())
        assert end == len(ids)
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
        n = sum(r.length for r in found)
        assert n <= limit and n.bit_count() == 1
    return by_sequence


def test_neighbours_are_the_best_unused_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, shard string")
    by_sequence = check(R.pack(docs, max_tokens=128).collect(), TEXTS, 128)
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for t in TEXTS]
    share = Counter(w for b in bags for w in b)
    mean = sum(b.total() for b in bags) / len(bags)

    def score(query, doc):
        weight = lambda w: math.log1p((len(bags) - share[w] + 0.5) / (share[w] + 0.5)) * bags[doc][w] * 2.2 / (bags[doc][w] + 1.2 * (0.25 + 0.75 * bags[doc].total() / mean))
        return sum(weight(w) for w in bags[query] if w in bags[doc])

    used, cut = set(), Counter()
    # one shard: sequences in their order; whole sequences of the long text come first and hold no rest
    for _, found in sorted(by_sequence.items()):
        seed, *others = found
        if not others and seed.length == 128 and seed.doc_tokens > 128 and seed.start + 128 <= seed.doc_tokens // 128 * 128:
            continue
        used.add(seed.doc_id)
        for r in others:
            if r.score is not None:
                free = [i for i in range(len(TEXTS)) if i not in used and len(ids_of(TEXTS[i])) % 128]
                assert math.isclose(r.score, score(seed.doc_id, r.doc_id), rel_tol=1e-5, abs_tol=1e-5)
                assert r.score >= max(score(seed.doc_id, i) for i in free) - 1e-4
                cut[r.doc_id] += 1
            used.add(r.doc_id)
        if sum(r.length for r in found) < 128:
            break  # the powers of two of the last sequence share its seed
    assert len(cut) > 30


@pytest.mark.parametrize(("shard", "limit"), [(1, 32), (7, 128), (1024, 1024)])
def test_pieces_are_whole_in_many_shards(spark, shard, limit):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    check(R.pack(docs, max_tokens=limit, shard_documents=shard).collect(), TEXTS, limit)


def test_like_documents_meet_though_they_lie_apart(spark):
    texts = [f"{t} note {i}" for i, t in enumerate(drawn(400, 9))]
    texts[5] = texts[395] = "quartz zebra umbrella lantern " * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_sequence = check(R.pack(docs, max_tokens=128, shard_documents=32).collect(), texts, 128)
    assert any({5, 395} <= {r.doc_id for r in found} for found in by_sequence.values())


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = R.pack(docs).collect()
    assert sum(r.length for r in got) == 10 and sum(r.doc_id is None for r in got) >= 2
    assert R.pack(docs.limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 10**6))
def test_fill_places_every_token_once(sizes, seed):
    r = np.random.default_rng(seed)
    many = r.integers(0, 4, len(sizes))
    terms, weights = r.integers(0, 6, int(many.sum())).astype(np.uint32), r.random(int(many.sum()))
    sequences = R.fill(sizes, terms, weights, many, 41)
    parts = defaultdict(list)
    for k, sequence in enumerate(sequences):
        total = sum(x[2] for x in sequence)
        assert total == 41 or k == len(sequences) - 1
        for doc, start, length, _ in sequence:
            parts[doc].append((start, length))
    assert all(sum(n for _, n in parts[i]) == size and sorted(parts[i])[0][0] == 0 for i, size in enumerate(sizes))
    if sequences:
        short = R.halved(list(sequences[-1]), 41)
        assert sum(x[2] for s in short for x in s) == sum(x[2] for x in sequences[-1])


def test_query_over_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [t for _, t in sorted(map(tuple, docs))]
    check(R.op12_retrieval_packing(spark, "/root/testdata/sf0.001").collect(), texts, 1024)
