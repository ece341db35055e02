import math

import duckdb


from meshwright.llm import mixing as M

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = duck.sql(M.OP8_SQL).df(), M.op8_poisson_mixing(spark, SF).toPandas()
    assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(want)].values.tolist()))


def test_counts_follow_the_target_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 'a', 'b') AS source", "CAST(id AS STRING) AS text", "1 AS copy")
    mixed = M.mix_sources(docs, {"a": 0.5, "b": 0.5}, epochs=2.0)
    assert mixed.columns[:4] == docs.columns and len(mixed.columns) == 7
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert all(abs(n - 4000) < 4 * 4000**0.5 for n in got.values())
    again = M.mix_sources(docs.repartition(7), {"a": 0.5, "b": 0.5}, epochs=2.0)
    assert mixed.exceptAll(again).isEmpty() and again.exceptAll(mixed).isEmpty()


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "CONCAT('s', id % 5) AS source", "'t' AS text")
    want = sorted(map(tuple, M.mix_sources(docs).collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 2)
    assert sorted(map(tuple, M.mix_sources(docs).collect())) == want


def test_large_and_zero_rates(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "doc_id long, source string, text string")
    got = {r.source: r["count"] for r in M.mix_sources(docs, {"a": 1.0, "b": 0.0}, epochs=500.0).groupBy("source").count().collect()}
    assert set(got) == {"a"} and abs(got["a"] - 1500) < 5 * 1500**0.5


def test_distributions_equal_the_sums_of_all_probabilities(spark):
    rates_ = [0.3, 7.0, 40.0, 900.0, 250_000.0]
    docs = spark.createDataFrame([(str(i),) for i in range(len(rates_))], "source string")
    got = {r.key: r for r in M.rates(docs, "source", {str(i): r for i, r in enumerate(rates_)}, sum(rates_) / len(rates_), 0.5).collect()}
    for i, rate in enumerate(rates_):
        r = got[str(i)]
        assert abs(r.rate - rate) < 1e-6 and len(r.cdf) < 26 * rate**0.5 + 60
        total, k = 0.0, r.first
        for c in r.cdf:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            k += 1
            assert abs(c - total) < 1e-9
        assert abs(total - 1) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 2), (1, None, None, 2), (None, "", "t", 3), (4, "b", "u" * 100_000, 1)], "doc_id long, source string, text string, rate int")
    rows = M.mix_sources(docs, epochs=20.0).collect()
    ones = [r for r in rows if r.doc_id == 1]
    assert len(ones) % 2 == 0 and {r.source for r in ones} == {None} and {r.rate for r in ones} == {2}
    assert {r.source for r in rows if r.doc_id is None} == {""}
    assert M.mix_sources(docs.limit(0)).collect() == []
