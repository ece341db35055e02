from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from meshwright.llm import merkle as M

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [None if v is None else str(v) for v in row]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels(line):
    """All levels of the tree over a line of digests."""
    found = [line]
    while len(line) > 1:
        line = [h(*line[i : i + 2]) for i in range(0, len(line), 2)]
        found.append(line)
    return found


def brute(rows):
    """leaf -> (subroot, root, siblings from the leaf up), as the contract states them."""
    by = defaultdict(list)
    for r in rows:
        by["" if r[2] is None else "=" + r[2]].append(r)
    lines = {g: levels([leaf(r) for r in sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in sorted(by, key=str.encode)}
    top = levels([x[-1][0] for x in lines.values()])
    out = defaultdict(list)
    for place, x in enumerate(lines.values()):
        for rank, d in enumerate(x[0]):
            path = []
            for at, tree in ((rank, x), (place, top)):
                for line in tree[:-1]:
                    path += [line[at ^ 1]] if at ^ 1 < len(line) else []
                    at //= 2
            out[d].append((x[-1][0], top[-1][0], h(*path)))
    return out


ROWS = [(i, "s", lang, i * 3, "text é " * (i % 5)) for i, lang in enumerate([None] * 9 + ["en"] * 23 + ["", "fr", "Ä", "a"])]
ROWS += [(None, None, "en", None, None), (7, "s", "en", 1, "x"), (7, "s", "en", 1, "x"), (7, "s", "en", 1, "w"), (900, "s", "en", 5, "long " * 200_000)]


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest_and_proofs_equal_brute_force(spark, bits):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, source string, lang string, n_chars long, text string, digest string, path int")
    leaves = docs.select("doc_id", M.group_key(docs.lang).alias("group"), M.leaf_digest(M.FIELDS).alias("digest"))
    manifest = M.build(leaves, "doc_id", "digest", bits=bits)
    asked = manifest.leaves.selectExpr("group", "rank", "doc_id", "digest AS leaf")
    got, want = M.verify(manifest.proofs(asked), "leaf").collect(), brute(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        # descent by the rank reaches the leaf itself
        assert r.digest == r.leaf and r.verified and r.folded_root == r.root
        assert (r.subroot, r.root, r.proof_sha256) in want[r.leaf]


def test_a_few_requests_are_answered_alone(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = M.build(docs.select("doc_id", M.group_key(docs.lang).alias("group"), M.leaf_digest(M.FIELDS).alias("digest")), "doc_id", "digest", bits=2)
    asked = manifest.leaves.where("doc_id = 20").selectExpr("group", "rank", "digest AS leaf", "sha2('other', 256) AS other")
    (row,) = M.verify(manifest.proofs(asked), "other").collect()
    assert row.digest == row.leaf and not row.verified and row.root == brute(ROWS)[row.leaf][0][1]


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame(ROWS[:1], "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select("doc_id", M.group_key(docs.lang).alias("group"), M.leaf_digest(M.FIELDS).alias("digest"))
    manifest = M.build(leaves, "doc_id")
    (row,) = M.verify(manifest.proofs(manifest.leaves.selectExpr("group", "rank", "digest AS leaf")), "leaf").collect()
    assert row.root == row.subroot == row.leaf == leaf(ROWS[0]) and row.proof_sha256 == h() and row.verified
    assert M.build(leaves.limit(0), "doc_id").leaves.count() == 0


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = duck.sql(M.OP13_SQL).df(), M.op13_merkle_manifest(spark, SF).toPandas()
    assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(want)].values.tolist()))
    assert 0 < (~got.verified).sum() < len(got)
