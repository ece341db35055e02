import random

import numpy as np
import pyarrow as pa
import pytest

from meshwright.llm import tokens as T

PATH = T.vocabulary_path(T.VOCABULARY)
ODD = ["", " a", "  a  b ", "a<|endoftext|> b", "x  y", "don't we'll\n\n  go\t \tx ", "²½ Ⅷ 中文 字 é́", "a\x1c b", "_a_ __ 12ab", " ", "\n", "x " * 3000]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", " ", "  ", "\n", "é", "²", "中", "<|endoftext|>", "'s", "1", "_", "!", "　", "th"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_block_frequencies_sum_to_the_tokenizers_counts():
    texts = ODD + mixed(1500)
    names, pre, doc, n = T.block_frequencies(pa.array(texts))
    pieces = np.array(T.count_pieces(names, PATH))
    got = np.bincount(doc, n * pieces[pre], len(texts)).astype(int)
    assert got.tolist() == T.count_pieces(texts, PATH)


def test_count_tokens_on_nulls_repeats_and_extra_columns(spark):
    texts = [None, *ODD, *mixed(50, 2)]
    rows = [(None if i == 5 else i, t, "x", i) for i, t in enumerate(texts)] + [(7, texts[7], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row long")
    want = sorted((str(r[0]), len((r[1] or "").encode()), T.count_pieces([r[1] or ""], PATH)[0]) for r in rows)
    for frequent in (0, 3, 10_000):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in T.count_tokens(docs, most_frequent=frequent).collect())
        assert got == want


def test_count_tokens_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(docs).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_the_tokenizer(spark, sf):
    got = {r.doc_id: r for r in T.op1_token_counts(spark, f"/root/testdata/{sf}").collect()}
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r, n in zip(rows, T.count_pieces([r.text or "" for r in rows], PATH)):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit, got[r.doc_id].n_bytes) == (n, n > 512, len((r.text or "").encode()))
