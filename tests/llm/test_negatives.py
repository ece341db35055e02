import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm import negatives as N

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 41), st.integers(0, 41), st.integers(0, 41), st.integers(1, 8), st.integers(0, 2**32 - 1))
def test_strassen_equals_the_plain_product(m, k, n, least, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-(2**24), 2**24, (m, k)), r.integers(-(2**24), 2**24, (n, k))
    assert (N.strassen(a, b.T, least) == a @ b.T).all()


def brute(rows, anchor):
    """The contract, row by row; ids are distinct or null."""
    held = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, va, ya in held:
        if a is not None and anchor(a):
            scored = [(sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in held if i != a]
            for goal, positive, _ in sorted((x for x in scored if x[2] == ya), key=key)[:5]:
                window = sorted((x for x in scored if x[2] != ya and 80 * goal <= 100 * x[0] <= 100 * goal), key=key)[:5]
                out += [(a, positive, k + 1, i, goal, score) for k, (score, i, _) in enumerate(window)]
    return sorted(out, key=str)


def drawn(n, width, seed, labels=3):
    r = random.Random(seed)
    # few distinct values, so scores tie
    return [(i, [r.choice((-0.5, 0.1, 0.25, 0.3)) for _ in range(width)], r.randrange(labels) if r.random() < 0.7 else 0) for i in range(n)]


ODD = [
    (1000, None, 1), (1001, [0.1, None], 1), (1002, [float("nan")] * 7, 1), (1003, [float("inf")] * 7, 0), (1004, [0.3] * 7, None), (1005, [], 0), (1010, [0.3, 0.25], 1), (None, [0.3] * 7, 1), (1020, [0.3] * 9, 0),
]


@pytest.mark.parametrize("tiles", [(2, 3), (512, 4096)])
def test_mined_rows_equal_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(N, "MERGED", 3)
    rows = drawn(60, 7, 5) + ODD
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", anchor_id string, row int")
    got = N.mine(table, anchor=table.vec_id % 5 == 0, tiles=tiles)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i % 5 == 0)


def test_few_rows_none_and_repeats(spark):
    one = spark.createDataFrame([(0, [0.5, 0.5], 1)], SCHEMA)
    assert N.mine(one).collect() == [] and N.mine(one.limit(0)).collect() == []
    # the repeat of an anchor is another row: its own positive
    twice = spark.createDataFrame([(0, [0.5], 1), (0, [0.5], 1), (3, [0.5], 2)], SCHEMA)
    assert sorted(map(tuple, N.mine(twice, anchor=twice.vec_id == 0).collect())) == [(0, 0, 1, 3, 128 * 128, 128 * 128)] * 2


def test_too_long_vectors_are_told(spark):
    with pytest.raises(Exception, match="too long for exact scores"):
        N.mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA)).collect()


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want, got = duck.sql(N.OP11_SQL).df(), N.op11_strassen_negatives(spark, SF).toPandas()
    assert len(got) and sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(want)].values.tolist()))
