"""Keyed notices over several batches and restarts."""

from meshwright.streaming import watch as W


def test_growth_and_timers_across_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    schema = "key string, ts timestamp, size long"

    def put(*rows):
        spark.createDataFrame(rows, "key string, ts string, size long").selectExpr("key", "CAST(ts AS timestamp) AS ts", "size").coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(folder))
        found = W.watched(stream, f"file://{out}", every_ms=3_600_000, late="0 seconds").collect()
        return sorted((r.key, r.notice, str(r.at) if r.at else "", r["size"]) for r in found)

    put(("a", "2024-01-01 00:00:00", 5), ("a", "2024-01-01 00:10:00", 9), ("b", "2024-01-01 00:20:00", 0), (None, "2024-01-01 00:20:00", 3), ("b", None, 3))
    first = run()
    assert first == [("a", "new output", "", 9)]
    # the second run goes on with sizes and timers of the first: b's size grows, a's does not, and an hour has passed for both
    put(("a", "2024-01-01 01:30:00", 7), ("b", "2024-01-01 01:25:00", 2))
    second = run()
    assert sorted(set(second) - set(first)) == [("a", "periodic", "2024-01-01 01:00:00", 9), ("b", "new output", "", 2), ("b", "periodic", "2024-01-01 01:20:00", 2)]
    # several periods at once
    put(("c", "2024-01-01 04:30:00", 1))
    third = run()
    assert sorted(x for x in set(third) - set(second) if x[0] == "a") == [("a", "periodic", f"2024-01-01 0{h}:00:00", 9) for h in (2, 3, 4)]
    assert run() == third
