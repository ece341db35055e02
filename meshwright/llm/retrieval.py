"""Lexical retrieval packing: each sequence is filled with the documents most like its first one by BM25.

Every text becomes token ids and an end id. What a long text has beyond whole sequences, or a short text as a whole, is packed by
retrieval. Words are hashed to 2 ** 20 terms; document frequencies and the mean length are counted over all documents. Documents go to the
shard of their most telling term: that of the highest BM25 weight among those that other documents have too; the terms follow each other in shards of some
1,024 documents, and the documents of a term that has more than that are dealt to several shards by a hash. A shard has an inverted
index of all its documents and all their terms. The first unused document seeds a sequence and is the query; the unused neighbours with the highest scores follow until the
sequence is full. Only the last one is cut, and its rest seeds the next sequence. The last sequence of a shard is cut into powers of two, so no sequence has padding.

Defined cases: a null or empty text has the end id only; texts of any length are encoded whole; a text without words has no neighbours and is taken in turn when nothing has a
common word; ties go to the document that comes first in the shard; repeated rows are packed as rows of their own; null ids are kept; an empty table gives
no rows; extra columns, whatever their names, are dropped. A word's frequency within a document counts up to 65,535, where the score no longer changes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, text_or_empty, write_table
from .packing import BLOCK_BYTES, END_ID, unit_ids
from .tokens import VOCABULARY, block_units, tokenizer, vocabulary_path

MAX_TOKENS = 1024
#: Hashed terms: their frequencies and shard bounds are broadcast, 20 MB whatever the corpus.
TERMS = 1 << 20
SHARD_DOCUMENTS = 1024
#: The usual parameters of BM25.
K1, B = 1.2, 0.75
#: What parts words (RE2).
NO_WORD = r"[^\pL\pM\pN_]+"


def unit_terms(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the words of each string in a row, and how many each has."""
    words = pc.split_pattern_regex(pc.utf8_lower(pa.array(strings, pa.string())), NO_WORD)
    flat = words.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    many = np.bincount(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())[kept], minlength=len(words))
    hashed = pd.util.hash_array(flat.to_numpy(zero_copy_only=False)[kept], categorize=False)
    return (hashed % np.uint64(TERMS)).astype(np.int64), many


def block_terms(strings: list[str], numbers: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text: number of the text, term, frequency, from the distinct units of a block."""
    flat, many = unit_terms(strings)
    pairs, times = np.unique(np.repeat(np.arange(len(per)), per) * max(len(strings), 1) + numbers, return_counts=True)
    doc, unit = pairs // max(len(strings), 1), pairs % max(len(strings), 1)
    wide = many[unit]
    at = np.repeat((np.cumsum(many) - many)[unit] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    keys = np.repeat(doc, wide) * TERMS + flat[at]
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.repeat(times, wide)[order]
    last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, np.int64)
    return keys[last] // TERMS, keys[last] % TERMS, np.diff(np.cumsum(times)[last], prepend=0)


def encoded(docs: DataFrame, identity: str, text: str, max_tokens: int, end_id: int, vocabulary: str) -> DataFrame:
    """One row per document: row, id, tokens, whole (CRC-32 of each full sequence of its ids), rest (the ids beyond), terms and times (packed), words."""
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    width = id_kind(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1, BLOCK_BYTES)):
            strings, numbers, per = block_units(part.column(1))
            ids, many = unit_ids(strings, numbers, per, vocabulary, end_id)
            doc, term, times = block_terms(strings, numbers, per)
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            words = np.diff(np.r_[0, np.cumsum(times)][ends])
            wide, term, times = ids.astype("<u4").tobytes(), term.astype("<u4").tobytes(), np.minimum(times, 65_535).astype("<u2").tobytes()
            narrow, step = ids.astype(width).tobytes(), np.dtype(width).itemsize
            whole, rest, stop = [], [], np.cumsum(many)
            for end, n in zip(stop.tolist(), many.tolist()):
                start = end - n
                last = end - n % max_tokens
                whole.append([zlib.crc32(wide[4 * i : 4 * (i + max_tokens)]) for i in range(start, last, max_tokens)])
                rest.append(narrow[step * last : step * end])
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            columns = [part.column(2), part.column(0), pa.array(many, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array([term[4 * i : 4 * j] for i, j in spans], pa.binary()), pa.array([times[2 * i : 2 * j] for i, j in spans], pa.binary()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "tokens", "whole", "rest", "terms", "times", "words"])

    return rows.mapInArrow(encode, f"row long, id {kind}, tokens long, whole array<long>, rest binary, terms binary, times binary, words long")


def id_kind(vocabulary: str) -> str:
    return "<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def joined(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values in a row, and how many each has."""
    data = values.to_pylist()
    return np.frombuffer(b"".join(data), kind), np.array([len(x) // np.dtype(kind).itemsize for x in data], np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that have each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS, np.int64)
        for batch in batches:
            held += np.bincount(joined(batch.column(0), "<u4")[0], minlength=TERMS)
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(held[terms])], names=["term", "n"])

    found = docs.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def bm25(idf: np.ndarray, times: np.ndarray, words: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds to a document's score: idf, frequency, the document's length."""
    return idf * times * (K1 + 1) / (times + K1 * (1 - B + B * words / mean))


def telling_terms(batch: pa.RecordBatch, idf: np.ndarray, mean: float) -> np.ndarray:
    """Each document's term of the highest weight; TERMS where no other document has one of its terms. idf is 0 for terms of a single document."""
    terms, many = joined(batch.column("terms"), "<u4")
    times, _ = joined(batch.column("times"), "<u2")
    weight = bm25(idf[terms], times.astype(float), np.repeat(batch.column("words").to_numpy(), many), mean)
    out = np.full(len(many), TERMS)
    some = np.flatnonzero(many)
    starts = (np.cumsum(many) - many)[some]
    if len(some):
        most = np.maximum.reduceat(weight, starts)
        first = np.flatnonzero(weight == np.repeat(most, many[some]))
        owner = np.repeat(np.arange(len(some)), many[some])[first]
        at = first[np.unique(owner, return_index=True)[1]]
        out[some] = np.where(most > 0, terms[at], TERMS)
    return out


def fill(sizes: list[int], terms: np.ndarray, weights: np.ndarray, many: np.ndarray, limit: int) -> list[list[tuple[int, int, int, float | None]]]:
    """Sequences of (document, start, length, score), all full but for the last: the shard's inverted index gives each seed its unused neighbours."""
    n = len(sizes)
    local, term = np.unique(terms, return_inverse=True)
    doc = np.repeat(np.arange(n), many)
    order = np.argsort(term, kind="stable")
    held, weight = doc[order], weights[order].astype(float)
    wide = np.bincount(term, minlength=len(local))
    first = np.cumsum(wide) - wide
    bounds = np.r_[0, np.cumsum(many)]
    free = np.array(sizes) > 0
    sequences: list[list[tuple[int, int, int, float | None]]] = []
    seed = start = 0
    while True:
        if not start:
            while seed < n and not free[seed]:
                seed += 1
            if seed == n:
                return sequences
            at = seed
            free[at] = False
        sequence = [(at, start, sizes[at] - start, None)]
        room, start = limit - sizes[at] + start, 0
        if room:
            asked = term[bounds[at] : bounds[at + 1]]
            asked = asked[wide[asked] > 1]
            spans = wide[asked]
            where = np.repeat(first[asked] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
            score = np.where(free, np.bincount(held[where], weight[where], n), -1.0)
            while room:
                best = int(score.argmax())
                if score[best] < 0:
                    break
                taken = min(room, sizes[best])
                sequence.append((best, 0, taken, float(score[best])))
                free[best], score[best] = False, -1.0
                room -= taken
                if taken < sizes[best]:
                    at, start = best, taken
        sequences.append(sequence)


def halved(sequence: list[tuple], limit: int) -> list[list[tuple]]:
    """A sequence that is not full, cut into powers of two, the largest first."""
    left = sum(x[2] for x in sequence)
    if left == limit:
        return [sequence]
    out = []
    for size in (1 << k for k in reversed(range(left.bit_length())) if left >> k & 1):
        out.append([])
        while size:
            doc, start, length, score = sequence.pop(0)
            taken = min(size, length)
            out[-1].append((doc, start, taken, score))
            size -= taken
            if taken < length:
                sequence.insert(0, (doc, start + taken, length - taken, score))
    return out


def pack(docs: DataFrame, identity: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per piece: identity, start, length, ids_crc32, doc_tokens, sequence_id, offset, and score, the neighbour's likeness to its sequence's seed (null for the
    seed and for whole sequences of a long text)."""
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    held = write_table(encoded(docs, identity, text, max_tokens, end_id, vocabulary), "encoded", "zstd")
    share = frequencies(held)
    total, mean = held.agg(F.count("*"), F.avg("words")).first()
    mean = max(mean or 0.0, 1.0)
    context = docs.sparkSession.sparkContext
    weighing = context.broadcast(np.log1p((total - share + 0.5) / (share + 0.5)).astype(np.float32))
    shared = context.broadcast(np.packbits(share > 1))
    width = id_kind(vocabulary)

    def keyed(batch: pa.RecordBatch) -> np.ndarray:
        return telling_terms(batch, np.where(np.unpackbits(shared.value), weighing.value, 0), mean)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            many += np.bincount(keyed(batch), minlength=TERMS + 1)
        found = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many[found])], names=["key", "n"])

    crowds = held.select("terms", "times", "words").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    sizes = np.zeros(TERMS + 1, np.int64)
    sizes[crowds["key"].to_numpy()] = crowds["n"].to_numpy()
    ahead = context.broadcast(np.r_[0, np.cumsum(sizes)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keyed(batch)
            spread = (batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / float(1 << 53)
            place = ahead.value[key] + (spread * (ahead.value[key + 1] - ahead.value[key])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(place // shard_documents)], names=[*batch.schema.names, "key", "shard"])

    kinds = ", ".join(f"{n} {k}" for n, k in held.dtypes)
    dealt = held.mapInArrow(deal, f"{kinds}, key long, shard long")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("row", "ascending")]).combine_chunks()
        batch = table.to_batches()[0]
        terms, many = joined(batch.column("terms"), "<u4")
        times, _ = joined(batch.column("times"), "<u2")
        weights = bm25(weighing.value[terms], times.astype(float), np.repeat(batch.column("words").to_numpy(), many), mean)
        rests, tokens, whole = batch.column("rest").to_pylist(), batch.column("tokens").to_pylist(), batch.column("whole").to_pylist()
        step = np.dtype(width).itemsize
        lengths = [len(x) // step for x in rests]
        sequences = fill(lengths, terms, weights, many, max_tokens)
        if sequences:
            sequences += halved(sequences.pop(), max_tokens)
        number = batch.column("shard")[0].as_py() << 32
        out = []
        for doc, crcs in enumerate(whole):
            for i, crc in enumerate(crcs):
                out.append((doc, i * max_tokens, max_tokens, crc, number, 0, None))
                number += 1
        for sequence in sequences:
            offset = 0
            for doc, start, length, score in sequence:
                ids = np.frombuffer(rests[doc], width)[start : start + length].astype("<u4")
                out.append((doc, tokens[doc] - lengths[doc] + start, length, zlib.crc32(ids.tobytes()), number, offset, score))
                offset += length
            number += 1
        doc, start, length, crc, sequence, offset, score = zip(*out)
        doc = pa.array(doc, pa.int64())
        columns = {identity: batch.column("id").take(doc), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": batch.column("tokens").take(doc), "sequence_id": sequence, "offset": offset, "score": pa.array(score, pa.float64())}
        return pa.table(columns)

    return dealt.groupBy("shard").applyInArrow(packed, f"`{identity}` {dict(held.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, score double")


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, score of every piece of every document."""
    return pack(read_table(spark, sf_dir, "documents"))
