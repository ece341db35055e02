import random

from meshwright.operators import cube as C

SCHEMA = "tile string, low int, high int"


def test_planted_faults_are_found(spark):
    blocks = [("a", 0, 3), ("a", 3, 5), ("a", 5, 10), ("b", 0, 4), ("b", 3, 10), ("c", 0, 2), ("c", 6, 10), ("d", 2, 8), ("d", 2, 3), (None, 0, 99), ("a", None, 4), ("a", 7, 7)]
    found = C.cover_faults(spark.createDataFrame(blocks, SCHEMA), tiles=spark.createDataFrame([("a",), ("e",)], "tile string"))
    assert sorted(map(tuple, found.collect())) == [("b", 3, 4, 2), ("c", 2, 6, 0), ("d", 0, 2, 0), ("d", 2, 3, 2), ("d", 8, 10, 0), ("e", 0, 10, 0)]
    assert C.cover_faults(spark.createDataFrame(blocks[:3], SCHEMA)).collect() == []
    assert C.cover_faults(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_equal_a_count_of_every_place(spark):
    r = random.Random(1)
    blocks = [(r.choice("aaaab"), a, a + r.randint(1, 6)) for a in (r.randrange(60) for _ in range(80))]
    found = C.cover_faults(spark.createDataFrame(blocks, SCHEMA)).collect()
    low, high = min(b[1] for b in blocks), max(b[2] for b in blocks)
    want = {(t, k): n for t in "ab" for k in range(low, high) if (n := sum(x == t and a <= k < b for x, a, b in blocks)) != 1}
    assert {(x.tile, k): x.n for x in found for k in range(x.low, x.high)} == want
