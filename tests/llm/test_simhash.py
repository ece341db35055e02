import random
import re

import numpy as np
import pytest
import xxhash

from meshwright.llm import simhash as S
from meshwright.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=3):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash_components(spark, f"/root/testdata/{sf}").collect()}
    assert got == want


@pytest.mark.parametrize("small", [2, 32])
def test_close_links_join_what_brute_force_joins(spark, small):
    rng = random.Random(small)
    prints = {rng.getrandbits(64) for _ in range(40)}
    base = rng.getrandbits(64)
    for _ in range(60):
        base = base ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64)) if rng.random() < 0.8 else rng.choice(sorted(prints))
        prints.add(base)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = S.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), small)
    for r in links.collect():
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components(prints, [p & (2**64 - 1) for p in prints])
    assert [roots.get(p, p) for p in prints] == want


def test_members_of_full_keys_get_longer_keys(spark):
    # all fingerprints that differ from a base in the low 11 bits: far more than a key may hold
    base = 0x0123456789ABC800
    prints = [base ^ x for x in range(96)]
    links = {(r.a, r.b) for r in S.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 8).collect()}
    assert links == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3, None, "x"), (2, " \n", "y"), (None, "a b c d", "z"), (9, "A b C d", "q"), (9, "A b C d", "q"), (5, "word " * 4000, "")], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.fingerprint_components(docs).collect())
    abcd, word = f"{brute_fingerprint('a b c d'):016x}", f"{brute_fingerprint('word ' * 4000):016x}"
    assert got == sorted([("3", "0" * 16, 2), ("2", "0" * 16, 2), ("None", abcd, 9), ("9", abcd, 9), ("9", abcd, 9), ("5", word, 5)])
    assert S.fingerprint_components(docs.limit(0)).collect() == []


def edited(words, share, rng):
    return [rng.choice("abcdefgh") * 5 if rng.random() < share else w for w in words]


def test_near_duplicates_are_caught_and_others_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    docs, origin = [], {}
    for g in range(30):
        base = [word() for _ in range(rng.randint(60, 400))]
        for k in range(rng.choice([1, 2, 3])):
            docs.append((len(docs), " ".join(edited(base, 0.01 * (k > 0), rng))))
            origin[len(docs) - 1] = g
    hub = [word() for _ in range(200)]
    passage = [word() for _ in range(60)]
    docs.append((len(docs), " ".join(hub)))
    origin[len(docs) - 1] = "hub"
    for _ in range(150):
        docs.append((len(docs), " ".join(edited(hub, 0.012, rng))))
        origin[len(docs) - 1] = "hub"
    for _ in range(60):
        docs.append((len(docs), " ".join([word() for _ in range(200)] + passage)))
        origin[len(docs) - 1] = len(docs)
    sets = [set(S.shingle_hashes(t.encode(), 5).tolist()) for _, t in docs]
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, g in origin.items():
        first = min(k for k, v in origin.items() if v == g)
        if d == first:
            assert d in kept
        elif len(sets[d] & sets[first]) >= 0.8 * len(sets[d] | sets[first]):
            assert d not in kept, (d, g)


def test_drop_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "u"), (1, "a b c", "v"), (None, "a b c", "w"), (4, None, "x")], "doc_id long, text string, digest string")
    got = [(r.doc_id, r.digest) for r in S.drop_near_duplicates(docs).collect()]
    assert sorted(d for d, _ in got if d is not None) == [1, 4] and (None, "w") in got
    assert S.drop_near_duplicates(docs.limit(0)).collect() == []


def test_pairs_of_long_texts_are_decided_on_their_whole_sets(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    docs = []
    for g in range(60):
        # a run of fresh words at the end: similarities just above and just below 0.8
        base, end = [word() for _ in range(1500)], round(1500 / 9) + rng.choice([-8, -5, 5, 8])
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-end] + [word() for _ in range(end)]))]
    sets = [set(S.shingle_hashes(t.encode(), 5).tolist()) for _, t in docs]
    want = {d for d, _ in docs if d % 2 == 0 or len(sets[d] & sets[d - 1]) < 0.8 * len(sets[d] | sets[d - 1])}
    assert 70 < len(want) < 110
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == want


def brute_kept(docs, similarity=0.8):
    """Ids that are the least of their component by the Jaccard similarity of five-word shingles."""
    sets = [set(S.shingle_hashes(t.encode(), 5).tolist()) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x & y and find(i) != find(j) and len(x & y) >= similarity * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d for i, (d, _) in enumerate(docs) if find(i) == i}


def phrased(rng, groups, size, phrase, tail, pair):
    """Groups of short texts that share a phrase and have tails of their own, each with one pair that pair(common, word) makes of the phrase."""
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for _ in range(groups):
        common = [word() for _ in range(phrase)]
        texts += [" ".join(common + [word() for _ in range(tail)]) for _ in range(size)]
        texts += [" ".join(t) for t in pair(common, word)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_pairs_that_share_one_uncrowded_part_are_compared(spark):
    def pair(common, word):
        first = word()
        return [first, *common, word()], [first, *common, word()]

    docs = phrased(random.Random(5), 12, 90, 16, 8, pair)
    want = brute_kept(docs)
    assert len(want) == len(docs) - 12
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == want


def test_pairs_that_share_crowded_parts_only_are_compared(spark):
    docs = phrased(random.Random(6), 6, 150, 40, 10, lambda common, word: ([*common, word(), word()], [*common, word(), word()]))
    want = brute_kept(docs)
    assert len(want) == len(docs) - 6
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == want


def test_marked_rows_are_all_that_are_wanted_and_few_others(spark):
    rows = spark.range(-5000, 5000).selectExpr("IF(id = 77, NULL, id) AS id", "id AS _mark")
    ids = spark.range(-5000, 5000, 100).toDF("k")
    wanted, n = {r.k for r in ids.collect()}, 10_000
    for most in (S.MOST_MARKS, 1 << 10):
        held = [r.id for r in S.marked(rows, "id", ids, most=most).collect()]
        others = [r.id for r in S.marked(rows, "id", ids, "left_anti", most=most).collect()]
        assert wanted <= set(held) and not wanted & set(others) and len(held) + len(others) == n
        assert len(held) < len(wanted) + n / 100 or most < S.MOST_MARKS
    assert S.marked(rows, "id", ids.limit(0)).count() == 0 and S.marked(rows, "id", ids.limit(0), "left_anti").count() == n


def shuffled_bytes(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_and_sketches_of_documents_without_pairs_do_not_move(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(1 << 40, size=600)) for _ in range(400)]
    texts[399] = texts[0] + " end"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r.doc_id: r.text for r in S.drop_near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == dict(enumerate(texts[:399])) and shuffled_bytes(spark) - before < sum(map(len, texts)) * 3 // 5
