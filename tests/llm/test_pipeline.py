from collections import defaultdict

import corpus_pipeline as P


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= sizes[4]


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048


def test_stages_take_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).collect() == []
