"""Token counts from distinct pre-tokens, and token ids for packing.

A byte-level BPE tokenizer first splits a text into pre-tokens and never merges across them, so a text's token count is the
sum over its distinct pre-tokens of frequency times pieces. count_tokens() lets each task turn a block of documents into
one row per distinct pre-token of the block, with the postings (document, frequency) packed beside it; the pieces of each
distinct pre-token of the corpus are counted once; an equality join brings them to the postings and a sum by document ends it.
The counts of a fixed number of pre-tokens that most blocks hold are broadcast, as a join's small side of bounded size, so that
their postings need no shuffle. No ids are materialised. A pre-token that is in every document gives one row per block at
most, so no key is hot. Rows are numbered while a table is scanned twice: docs should be read from files, not drawn anew.

Defined cases: a null or empty text has 0 tokens, repeated rows are each counted, a null id is kept as such, an empty table
gives no rows; a very long text is a block of its own; extra columns, whatever their names, are dropped. The text of a special token counts as that token, as the tokenizers library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lengths, read_table, slices, text_or_empty, write_table

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Fixed value: the tokenizer's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which every Unicode version and Python's re agree with the pattern; units with others are left whole for the tokenizer to split.
PLAIN = re.compile("[\t\n\r -~¡¿«»À-ɏ‐-‧]*")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space of any kind beside a space, a space at either end, or the special token (RE2).
LOOSE = r"[\s\pZ\x{85}\x0b\x1c-\x1f] | [\s\pZ\x{85}\x0b\x1c-\x1f]|^ | $|<\|endoftext\|>"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Text bytes that a task holds as units and postings at a time. Each takes some 30 bytes of work arrays.
BLOCK_BYTES = 4 << 20
#: Postings that a task weighs at a time.
POSTING_BYTES = 8 << 20
#: Pre-tokens, of so many bytes at most, whose piece counts every task gets: some 6 MB. They cover most of a corpus's postings; a join brings the rest.
MOST_FREQUENT, SHORT_BYTES = 200_000, 32


@lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(1)
def fast_encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by the vocabulary's own merges, which its numbers rank, in a library that takes a fifth of the time."""
    import tiktoken

    bytes_of = byte_of()
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in tokenizer(path).get_vocab(with_added_tokens=False).items() if token != SPECIAL}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """text cut where no token can cross: before a space between two non-spaces, and around the special token."""
    if SPECIAL in text:
        found = []
        for i, part in enumerate(text.split(SPECIAL)):
            found += [SPECIAL] * (i > 0) + units(part)
        return found
    if not text:
        return []
    first, *rest = CUT.split(text)
    return [first, *[" " + x for x in rest]]


def pretokens(unit: str, plain: bool = False) -> list[str]:
    """The pre-tokens of a unit; one with unusual characters stays whole, so that the tokenizer's own tables split it."""
    return PLAIN_PATTERN.findall(unit) if plain or unit != SPECIAL and (unit.isascii() or PLAIN.fullmatch(unit)) else [unit]


def count_pieces(strings: list[str], path: str) -> list[int]:
    """Tokens of each string."""
    return [len(x.ids) for x in tokenizer(path).encode_batch(strings, add_special_tokens=False)]


def block_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of a block of texts (no nulls), the units in their order as numbers of these, and how many each text has."""
    loose = pc.match_substring_regex(texts, LOOSE)
    tight = pc.split_pattern(texts.filter(pc.invert(loose)), " ")
    cut = [units(x) for x in texts.filter(loose).to_pylist()]
    other = [u for found in cut for u in found]
    per = np.zeros(len(texts), np.int64)
    mask = loose.to_numpy(zero_copy_only=False)
    per[mask] = [len(x) for x in cut]
    per[~mask] = np.where(pc.equal(pc.binary_length(texts.filter(pc.invert(loose))), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(tight).to_numpy(zero_copy_only=False))
    pieces = tight.flatten()
    keep = np.ones(len(pieces), bool)
    starts = tight.offsets.to_numpy()[:-1] - tight.offsets.to_numpy()[0]
    spaced = keep.copy()
    spaced[starts] = False
    keep[starts[per[~mask] == 0]] = False
    encoded = pc.dictionary_encode(pa.concat_arrays([pieces, pa.array([u[1:] if u[:1] == " " else u for u in other], pieces.type)]))
    code = encoded.indices.to_numpy().astype(np.int64) * 2
    code[: len(pieces)] += spaced
    code[len(pieces) :] += np.fromiter((u[:1] == " " for u in other), bool, len(other))
    code = np.concatenate([code[: len(pieces)][keep], code[len(pieces) :]])
    order = np.concatenate([np.repeat(np.flatnonzero(~mask), per[~mask]), np.repeat(np.flatnonzero(mask), per[mask])])
    if mask.any():
        code = code[np.argsort(order, kind="stable")]
    # codes are small numbers, so those that occur are told apart without a sort
    there = np.zeros(2 * len(encoded.dictionary), bool)
    there[code] = True
    distinct = np.flatnonzero(there)
    numbers = (np.cumsum(there) - 1)[code]
    strings = encoded.dictionary.take(pa.array(distinct // 2)).to_pylist()
    return [" " + x if odd else x for x, odd in zip(strings, (distinct & 1).tolist())], numbers, per


def block_pretokens(texts: pa.Array) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens with numbers; the pre-tokens of the units in a row and how many each has; and the units of the texts as block_units() gives them."""
    strings, numbers, per = block_units(texts)
    plain = not any(SPECIAL in x for x in strings) and PLAIN.fullmatch("".join(strings)) is not None
    split = [pretokens(u, plain) for u in strings]
    flat = [p for found in split for p in found]
    names = {p: i for i, p in enumerate(dict.fromkeys(flat))}
    return names, np.fromiter(map(names.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, split), np.int64, len(split)), numbers, per


def block_frequencies(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens; then sorted by these: number of the pre-token, of the text, frequency."""
    names, members, many, numbers, per = block_pretokens(texts)
    n = max(len(texts), 1)
    pairs, times = np.unique(numbers * n + np.repeat(np.arange(len(texts)), per), return_counts=True)
    unit, doc = pairs // n, pairs % n
    wide = many[unit]
    at = np.repeat((np.cumsum(many) - many)[unit] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    keys = members[at] * n + np.repeat(doc, wide)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.repeat(times, wide)[order]
    first = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, np.int64)
    total = np.cumsum(times)[first]
    return list(names), keys[first] // n, keys[first] % n, np.diff(total, prepend=0)


def frequent(counted: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the pre-tokens that most blocks hold: short ones, at most so many, whatever the corpus. Numbers of blocks are told apart in
    steps of a sixteenth, so some 700 rows at most are looked at to find where to stop."""
    short = counted.where(F.octet_length("pretoken") <= SHORT_BYTES)
    level = F.floor(F.log2(F.col("blocks").cast("double")) * 16)
    held = sorted(((r.level, r["count"]) for r in short.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, total = None, 0
    for blocks, n in held:
        total += n
        if total > most:
            break
        least = blocks
    if least is None:
        return {}
    return {r.pretoken: r.pieces for r in short.where(level >= least).select("pretoken", "pieces").collect()}


def pack_postings(doc: np.ndarray, times: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each run of postings: the texts' numbers (two bytes each), then the frequencies (one byte each; more than 255 as several postings)."""
    extra = (times - 1) // 255
    if extra.any():
        doc, wide = np.repeat(doc, extra + 1), extra + 1
        last = np.cumsum(wide)
        shares = np.full(int(last[-1]), 255)
        shares[last - 1] = times - 255 * extra
        times, starts, ends = shares, (last - wide)[starts] if len(starts) else starts, last[ends - 1]
    where, shares = doc.astype("<u2").tobytes(), times.astype("<u1").tobytes()
    return pa.array([where[2 * i : 2 * j] + shares[i:j] for i, j in zip(starts.tolist(), ends.tolist())], pa.binary())


def count_tokens(docs: DataFrame, identity: str = "doc_id", text: str = "text", vocabulary: str | None = None, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """identity, n_bytes, n_tokens for each row of docs."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, BLOCK_BYTES):
                yield pa.RecordBatch.from_pydict({"pretoken": pa.array(list(block_pretokens(part.column(0))[0]), pa.string())})

    @F.pandas_udf("int")
    def pieces(strings):
        import pandas as pd

        return pd.Series(count_pieces(strings.tolist(), path), dtype="int32")

    counted = rows.select("text").mapInArrow(distinct, "pretoken string").groupBy("pretoken").agg(F.count("*").alias("blocks")).withColumn("pieces", pieces("pretoken"))
    counted = write_table(counted, "pretokens", "zstd")
    common = docs.sparkSession.sparkContext.broadcast(frequent(counted, most_frequent))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                names, pre, doc, times = block_frequencies(part.column(1))
                known = np.fromiter((common.value.get(p, -1) for p in names), np.int64, len(names))
                sure = np.bincount(doc, times * np.maximum(known[pre], 0), part.num_rows).astype(np.int64)
                rest = known[pre] < 0
                pre, doc, times = pre[rest], doc[rest], times[rest]
                ends = np.flatnonzero(np.r_[pre[1:] != pre[:-1], True]) + 1 if len(pre) else np.zeros(0, np.int64)
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                base = part.column(2)[0].as_py()
                about = pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths(part.column(1)), pa.int64()), pa.array(sure)], names=["id", "n_bytes", "n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, about.schema) as stream:
                    stream.write_batch(about)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{SPECIAL}{base}", *[names[k] for k in pre[starts]]], pa.string()),
                        pa.array(np.full(len(ends) + 1, base), pa.int64()),
                        pa.concat_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pack_postings(doc, times, starts, ends)]),
                    ],
                    names=["pretoken", "row", "data"],
                )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, POSTING_BYTES)):
            postings = batch.filter(pc.is_valid(batch.column("pieces")))
            data = postings.column("data").to_pylist()
            wide = np.fromiter((len(x) // 3 for x in data), np.int64, len(data))
            where = np.frombuffer(b"".join(x[: 2 * n] for x, n in zip(data, wide.tolist())), "<u2").astype(np.int64)
            times = np.frombuffer(b"".join(x[2 * n :] for x, n in zip(data, wide.tolist())), "<u1").astype(np.int64)
            row, back = np.unique(np.repeat(postings.column("row").to_numpy(), wide) + where, return_inverse=True)
            n = np.bincount(back, times * np.repeat(postings.column("pieces").to_numpy(zero_copy_only=False), wide), len(row)).astype(np.int64)
            blocks = batch.filter(pc.is_null(batch.column("pieces")))
            for base, stored in zip(blocks.column("row").to_pylist(), blocks.column("data").to_pylist()):
                about = pa.ipc.open_stream(stored).read_next_batch()
                yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(about.num_rows)), *about.columns], names=["row", "id", "n_bytes", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.nulls(len(row), id_arrow), pa.nulls(len(row), pa.int64()), pa.array(n)], names=["row", "id", "n_bytes", "n"])

    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    postings = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(post, "pretoken string, row long, data binary")
    joined = postings.join(counted.select("pretoken", "pieces"), "pretoken", "left").select("row", "data", "pieces")
    weighed = joined.mapInArrow(weigh, f"row long, id {id_type}, n_bytes long, n long")
    return weighed.groupBy("row").agg(F.max("id").alias(identity), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (over 512 tokens) of every document."""
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
