"""Best-fit packing by patterns of few documents.

Every text becomes token ids and an end id; ids longer than a sequence are cut so that only the first piece is short. Only
the histogram of piece lengths (at most max_tokens bins) reaches the driver. There, patterns of one to four lengths are
enumerated, non-negative least squares fits how often each pattern repeats, at several prices of a sequence, the counts are
rounded, and the lengths that are left are packed by best fit decreasing, again on the histogram; the fit with the fewest
sequences is taken. The outcome is a table of
slots (length, first rank, last rank, first sequence, offset), bounded by max_tokens and not by the corpus. Pieces are ranked
within their length by counts per (length, bucket), so no task sees all pieces of a frequent length, and look their slot up.

Defined cases: a null or empty text is one piece that holds the end id; a very long text gives as many pieces as it takes; repeated rows are packed as rows of their own; extra
columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, slices, text_or_empty, write_table
from .tokens import PLAIN, SPECIAL, VOCABULARY, block_units, fast_encoder, tokenizer, vocabulary_path

MAX_TOKENS = 2048
END_ID = 0
#: Text bytes that a task encodes at a time.
BLOCK_BYTES = 8 << 20
#: Units (RE2) of a space before anything but spaces at both ends, and how many of them are encoded side by side.
SPACED, JOINED = r"(?s)^ [^\s\pZ\x{85}\x0b\x1c-\x1f](?:.*[^\s\pZ\x{85}\x0b\x1c-\x1f])?$", 1 << 16
#: Pieces of one length that are ranked together.
RANKED = 200_000
#: Patterns that enter a least-squares fit at most, and the prices of a sequence that are tried.
MOST_PATTERNS = 16_384
PRICES = (0.0, 0.02, 0.1, 0.4)
#: Prices at which new patterns are sought, one fit each. Fits have as many updates as their size allows, within
#: bounds: for new patterns, and for the repeats that are taken.
COLUMN_PRICES = (0.4, 0.4, 0.4, 0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05)
COLUMN_ROUNDS, LAST_ROUNDS = (6_000_000, 50, 200), (24_000_000, 200, 1000)


@lru_cache(1)
def bytes_of_ids(vocabulary: str) -> np.ndarray:
    """How many bytes each id stands for, in fast_encoder()."""
    library = fast_encoder(vocabulary).__self__
    out = np.zeros(library.n_vocab, np.int64)
    for token in library.token_byte_values():
        out[library.encode_single_token(token)] = len(token)
    return out


def encode_units(strings: list[str], vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of units in a row, where each unit's begin and how many it has: by the vocabulary's ranks for usual characters, else from the tokenizer itself.
    Usual units of one space and no other at their ends are encoded side by side, as no token crosses from one to the next."""
    fast = fast_encoder(vocabulary)
    begin, many = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    plain = np.fromiter((u.isascii() or PLAIN.fullmatch(u) is not None for u in strings), bool, len(strings))
    spaced = plain & pc.match_substring_regex(pa.array(strings, pa.string()), SPACED).to_numpy(zero_copy_only=False)
    out, held = [], 0
    for some in np.split(np.flatnonzero(spaced), range(JOINED, int(spaced.sum()), JOINED)):
        own = [strings[i] for i in some.tolist()]
        ids = np.array(fast("".join(own)), np.int64)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(own, pa.string())), np.int64))
        covered = np.cumsum(bytes_of_ids(vocabulary)[ids])
        last = np.searchsorted(covered, ends)
        if len(ids) and last[-1] < len(ids) and (covered[last] == ends).all():
            many[some] = np.diff(last + 1, prepend=0)
            begin[some] = held + last + 1 - many[some]
            out.append(ids)
            held += len(ids)
        else:
            spaced[some] = False
    rest = np.flatnonzero(~spaced).tolist()
    found: dict[int, list[int]] = {i: [tokenizer(vocabulary).token_to_id(SPECIAL)] if strings[i] == SPECIAL else fast(strings[i]) for i in rest if plain[i] or strings[i] == SPECIAL}
    odd = [i for i in rest if i not in found]
    found |= {i: x.ids for i, x in zip(odd, tokenizer(vocabulary).encode_batch([strings[i] for i in odd], add_special_tokens=False))}
    many[rest] = [len(found[i]) for i in rest]
    begin[rest] = held + np.cumsum(many[rest]) - many[rest]
    out.append(np.fromiter(chain.from_iterable(found[i] for i in rest), np.int64, int(many[rest].sum())))
    return np.concatenate(out).astype(np.uint32), begin, many


def block_ids(texts: pa.Array, vocabulary: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block of texts in a row, each text closed by the end id, and how many each text has."""
    return unit_ids(*block_units(texts), vocabulary, end_id)


def unit_ids(strings: list[str], numbers: np.ndarray, per: np.ndarray, vocabulary: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the block's distinct units, their numbers in a row and how many of these each text has."""
    flat, begin, many = encode_units(strings, vocabulary)
    wide = many[numbers]
    at = np.repeat(begin[numbers] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    running = np.concatenate([[0], np.cumsum(wide)])
    ends = running[np.cumsum(per)]
    out = np.insert(flat[at], ends, np.uint32(end_id))
    return out, np.diff(ends, prepend=0) + 1


def pieces(docs: DataFrame, identity: str, text: str, max_tokens: int, end_id: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """One row per piece: identity, piece, start, length, ids_crc32, row (unique per document row) and, if wanted, the ids as little-endian bytes."""
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    rows = docs.select(F.col(identity).alias(identity), text_or_empty(text).alias("_text")).withColumn("row", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)[identity]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                ids, per = block_ids(part.column(1), vocabulary, end_id)
                data = ids.astype("<u4").tobytes()
                out: list[tuple] = []
                base = 0
                for i, n in enumerate(per.tolist()):
                    first = n % max_tokens or max_tokens
                    for k, start in enumerate([0, *range(first, n, max_tokens)]):
                        size = first if k == 0 else max_tokens
                        chunk = data[4 * (base + start) : 4 * (base + start + size)]
                        out.append((i, k, start, size, zlib.crc32(chunk), chunk if with_ids else None))
                    base += n
                at, piece, start, size, crc, chunk = zip(*out) if out else [()] * 6
                at = pa.array(at, pa.int64())
                columns = [part.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), part.column(2).take(at)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(chunk, pa.binary())] if with_ids else [])], names=[identity, "piece", "start", "length", "ids_crc32", "row", *(["ids"] if with_ids else [])])

    return rows.mapInArrow(cut, f"`{identity}` {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * with_ids)


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, max_tokens: int, most: int = MOST_PATTERNS) -> list[tuple[int, ...]]:
    """Multisets of one to four lengths to which no length that occurs can be added, or that end with the largest that fits: for every length alone and
    with others, the commonest first, closed by one more or by two alike. lengths are in falling order."""
    have = np.zeros(max_tokens + 1, bool)
    have[lengths] = True
    # the largest length that occurs at or below each size
    below = np.maximum.accumulate(np.where(have, np.arange(max_tokens + 1), 0))
    common = lengths[np.argsort(-counts, kind="stable")].tolist()
    found: dict[tuple[int, ...], None] = {}

    def close(parts: tuple[int, ...]) -> None:
        left = max_tokens - sum(parts)
        last = int(below[left]) if left > 0 else 0
        found[tuple(sorted(parts + ((last,) if last else ()), reverse=True))] = None

    def partners(a: int) -> Iterator[tuple[int, ...]]:
        for b in common:
            if a + b < max_tokens:
                yield (a, b)
                if c := int(below[(max_tokens - a - b) // 2]):
                    yield (a, b, c)
        for b in common[:64]:
            for c in common[:64]:
                if c <= b and a + b + c < max_tokens:
                    yield (a, b, c)

    for a in lengths.tolist():
        close((a,))
    share = max(1, (most - len(found)) // len(lengths))
    for a in lengths.tolist():
        for parts in islice(partners(a), share):
            close(parts)
    return list(found)[:most]


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, price: float = 0.0, rounds: tuple[int, int, int] = LAST_ROUNDS) -> np.ndarray:
    """Non-negative least squares of pattern repeats to the histogram, each bin's error in proportion to its count, with a price for every sequence that
    decides between fits that are alike. Multiplicative updates keep repeats non-negative."""
    rows = np.array([v for p in patterns for v in p], np.int64)
    sizes = np.array([len(p) for p in patterns])
    columns = np.repeat(np.arange(len(patterns)), sizes)
    share = 1 / np.maximum(counts, 1)
    uses = np.bincount(rows, minlength=len(counts))
    x = np.bincount(columns, counts[rows] / uses[rows], len(patterns)) / sizes
    entries, fewest, most = rounds
    for _ in range(min(max(entries // len(rows), fewest), most)):
        made = np.bincount(rows, x[columns], len(counts)) * share
        x *= sizes / np.maximum(np.bincount(columns, made[rows], len(patterns)) + price, 1e-12)
    return x


def fitted_groups(left: np.ndarray, patterns: list[tuple[int, ...]], repeats: np.ndarray, max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with whole repeats that the histogram holds, the fullest first, and what is left by best fit."""
    left, groups = left.copy(), []
    whole = np.rint(repeats).astype(np.int64)
    for k in np.lexsort((-whole, [max_tokens - sum(p) for p in patterns])):
        need = Counter(patterns[k])
        if whole[k] and (n := min(int(whole[k]), *(int(left[v]) // m for v, m in need.items()))):
            groups.append((patterns[k], n))
            for v, m in need.items():
                left[v] -= n * m
    return groups + best_fit(left, max_tokens)


def best_fillings(values: np.ndarray, lengths: np.ndarray, max_tokens: int) -> list[tuple[float, tuple[int, ...]]]:
    """For each length the multiset with it that fits and is worth most, of any number of lengths, with its worth: a knapsack over all sizes. values are those of the lengths."""
    best, last = np.zeros(max_tokens + 1), np.zeros(max_tokens + 1, np.int64)
    for size in range(1, max_tokens + 1):
        fits = lengths <= size
        worth = np.where(fits, best[np.maximum(size - lengths, 0)] + values, 0.0)
        k = int(worth.argmax())
        best[size], last[size] = (worth[k], lengths[k]) if worth[k] > best[size - 1] else (best[size - 1], 0)
    found = []
    for v, value in zip(lengths.tolist(), values.tolist()):
        parts, room = [v], max_tokens - v
        worth = value + float(best[room])
        while room > 0:
            if last[room]:
                parts.append(int(last[room]))
                room -= int(last[room])
            else:
                room -= 1
        found.append((worth, tuple(sorted(parts, reverse=True))))
    return found


def priced_patterns(left: np.ndarray, lengths: np.ndarray, patterns: list[tuple[int, ...]], max_tokens: int) -> list[tuple[int, ...]]:
    """The patterns and those that the fit asks for: what a fit lacks of a length, in units of the price of a sequence, is what one more of it is worth, and every pattern that is
    worth more than a sequence costs takes part in the next fit. Patterns that no fit uses make room."""
    known = dict.fromkeys(patterns)
    for price in COLUMN_PRICES:
        held = list(known)
        x = fit_repeats(held, left, price, COLUMN_ROUNDS)
        made = np.bincount([v for p in held for v in p], np.repeat(x, [len(p) for p in held]), len(left))
        values = np.maximum(1 - made[lengths] / left[lengths], 0) / price
        new = [p for worth, p in best_fillings(values, lengths, max_tokens) if worth > 1 + 1e-3 and p not in known]
        if len(known) + len(new) > MOST_PATTERNS:
            known = dict.fromkeys([held[k] for k in np.argsort(-x, kind="stable")[: MOST_PATTERNS - len(new)]])
        known |= dict.fromkeys(new)
    return list(known)


def plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, past the last rank, first sequence, offset) that place every piece of the histogram: of the fits by all prices the one
    with the fewest sequences, or best fit alone, should it need no more."""
    left = np.zeros(max_tokens + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    full = int(left[max_tokens])
    left[max_tokens] = 0
    groups = best_fit(left, max_tokens)
    lengths = np.flatnonzero(left)[::-1]
    least = -(-int((left * np.arange(max_tokens + 1)).sum()) // max_tokens)
    if len(lengths) and sum(n for _, n in groups) > least:
        patterns = priced_patterns(left, lengths, enumerate_patterns(lengths, left[lengths], max_tokens, MOST_PATTERNS // 2), max_tokens)
        for price in PRICES:
            repeats = fit_repeats(patterns, left, price)
            for whole in (np.rint(repeats), np.floor(repeats + 1e-6)):
                groups = min(fitted_groups(left, patterns, whole, max_tokens), groups, key=lambda found: sum(n for _, n in found))
    groups = [((max_tokens,), full)] * (full > 0) + groups
    slots, rank, sequence = [], np.zeros(max_tokens + 1, np.int64), 0
    for p, n in groups:
        offset = 0
        for v in p:
            slots.append((v, int(rank[v]), int(rank[v]) + n, sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    return slots


def best_fit(left: np.ndarray, max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: groups of alike open sequences by the room they have."""
    room: dict[int, list[list]] = defaultdict(list)
    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        for r in sorted(k for k in room if k >= v):
            while n and room[r]:
                parts, m = room[r][-1]
                fill = r // v  # as many of this length as fit in one of them
                full = min(m, n // fill) if fill else 0
                if full:
                    taken, each = full, fill
                else:
                    taken, each = 1, n
                if taken == m:
                    room[r].pop()
                else:
                    room[r][-1][1] = m - taken
                room[r - each * v].append([parts + (v,) * each, taken])
                n -= taken * each
            if not n:
                break
        fill = max_tokens // v
        if n // fill:
            room[max_tokens - fill * v].append([(v,) * fill, n // fill])
        if n % fill:
            room[max_tokens - n % fill * v].append([(v,) * (n % fill), 1])
    return [(parts, m) for groups in room.values() for parts, m in groups if m]


def pack(docs: DataFrame, identity: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, ranked: int = RANKED) -> DataFrame:
    """One row per piece: identity, piece, start, length, ids_crc32, sequence_id, offset (and ids). The pieces are written to the shared folder once, as
    several passes read them. Pieces of a length are ranked in as many buckets as their number asks for, so no length is a hot key."""
    cut = write_table(pieces(docs, identity, text, max_tokens, end_id, vocabulary, with_ids), "pieces", "zstd")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    many = [-(-histogram.get(n, 0) // ranked) or 1 for n in range(max_tokens + 1)]
    bucket = F.pmod(F.xxhash64("row", "piece"), F.get(F.lit(many), F.col("length").cast("int")))
    bucketed = cut.withColumn("bucket", bucket)
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = sorted(plan(histogram, max_tokens))
    table = np.array(order, np.int64).reshape(-1, 5)
    wide = 1 << 40
    shared = docs.sparkSession.sparkContext.broadcast((table[:, 0] * wide + table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    ranked_pieces = bucketed.join(ahead, ["length", "bucket"]).withColumn("rank", F.col("ahead") + inside - 1).drop("bucket", "ahead", "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, sequence, offset = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() * wide + rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    kept = [f"`{n}` {k}" for n, k in ranked_pieces.dtypes if n != "rank"]
    return ranked_pieces.mapInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"]))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    packed = pack(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
