"""Removal of repeated passages by a run-length compressed Burrows-Wheeler index.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller identity, or earlier in
the same document. Equal strings of that length share an anchor, the least hashed k-mer among all theirs (a minimizer), at the
same place. So the corpus is cut by anchors: each anchor governs a run of string starts, and its context is the bytes that
these strings cover. Contexts are dealt by anchor:

1. Anchors that occur once have no repeats and are dropped. A block of documents sends each anchor once, with its count and places.
2. Of equal contexts in a block of documents the first goes on, the others are repeats as they are. However often a passage
   occurs, each block sends its context once.
3. Contexts meet by anchor. Of equal ones the first stays; different ones may still share strings, where copies begin or end.
   For these, tasks build the index of a block of contexts: the multi-string Burrows-Wheeler transform, kept as its runs with the
   text positions sampled at both ends of each run. Every context is streamed through the index from its end, all contexts in
   step, each step an LF mapping over runs. Inside a run a match with the suffix ranked before grows by one byte; at a run's head
   it starts anew from the sampled ends of this run and of the symbol's run before. Matches of `length` bytes mark equal strings,
   whose first stays. An anchor with more than CROWDED contexts is made longer: its strings are dealt by where it lies in them,
   each deal by the longer run of bytes that its strings share, until no anchor fills a task.
4. Removed runs are merged per document, and the kept bytes are hashed.

Defined cases: a null or empty text has no bytes; a text shorter than length bytes loses nothing; rows that repeat an identity
are ordered by a hash of their text, and of rows that repeat both the first keeps what is new and the others lose it; a null
identity sorts first; a very long text is cut into contexts as any other; extra columns are dropped by repeated_spans() and kept by drop_repeats(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, slices, text_or_empty, write_table

LENGTH = 100
KMER = 24
#: Contexts of an anchor, counted once per block, up to which they meet in one task: some 2 MB.
CROWDED = 16_000
#: Text bytes that a task looks for anchors in at a time, and context bytes that one index holds.
BLOCK_BYTES = 2 << 20
INDEX_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many bytes, by doubling."""
    power, span = ODD, 1
    level = TABLE[data]
    done, taken = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & span:
                # the bytes taken so far come first
                done = level if done is None else done[: len(level) - taken] * power + level[taken:] if len(level) > taken else level[:0]
                taken += span
            if taken == size:
                return mixed(done)
            if len(level) <= span:
                return level[:0]
            level = level[:-span] * power + level[span:]
            power, span = power * power, span * 2


def governed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts at data[start:end]: hash of each anchor, first start of a string it governs (in data), how many, and the anchor's place."""
    window = length - kmer + 1
    hashes = rolling(data, kmer)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    place = np.uint64((1 << 32) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    # starts of strings that lie within one text
    inside = np.zeros(len(least) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    valid = np.cumsum(inside)[:-1] > 0
    at = (least & place).astype(np.int64)
    fresh = valid & np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]]
    fresh[starts[long]] = True
    begin = np.flatnonzero(fresh)
    stop = np.flatnonzero(np.r_[fresh[1:], True] & valid | valid & ~np.r_[valid[1:], False])
    return hashes[at[begin]], begin, stop - begin + 1, at[begin]


class RunIndex:
    """The run-length Burrows-Wheeler transform of a set of byte strings, with samples at run ends."""

    def __init__(self, strings: list[bytes], length: int) -> None:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) if len(ends) else 0
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends - 1] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.ends, self.starts, self.length = ends - 1, ends - sizes - 1, length
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes to the string's end, with it
        # 7 symbols of 9 bits from each place on
        self.packed, padded = np.zeros(n, np.int64), np.concatenate([text, np.zeros(7, np.int64)])
        for k in range(7):
            self.packed = self.packed << 9 | np.where(self.left > k, padded[k : k + n], 0)
        rank = self.sort(self.packed, self.left, ends - 1)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        preceding = np.roll(text, 1)
        preceding[self.starts] = 0
        last = preceding[order]
        head = np.flatnonzero(np.r_[True, last[1:] != last[:-1]]) if n else np.zeros(0, np.int64)
        self.head, self.symbol = head, last[head]
        self.run_size = np.diff(np.r_[head, n])
        self.first_sample = order[head]
        self.last_sample = order[np.r_[head[1:], n] - 1] if n else head
        # where the first of each run goes: symbols sort runs, in their order; and the run of the same symbol before it
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.goes = np.empty(len(head), np.int64)
        self.goes[by_symbol] = np.cumsum(self.run_size[by_symbol]) - self.run_size[by_symbol]
        self.before = np.full(len(head), -1)
        follows = np.flatnonzero(self.symbol[by_symbol][1:] == self.symbol[by_symbol][:-1]) + 1
        self.before[by_symbol[follows]] = by_symbol[follows - 1]
        self.end_rank = rank[self.ends]

    @staticmethod
    def sort(packed: np.ndarray, left: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of each suffix (of equal ones the earlier string's first), by prefix doubling from 7 symbols on."""
        n = len(packed)
        if not n:
            return np.zeros(0, np.int64)
        depth, where = 7, np.arange(n)
        # strings that end within the first symbols are told apart by their number
        ends_soon = np.flatnonzero(left <= depth)
        tie = np.zeros(n, np.int64)
        tie[ends_soon] = np.searchsorted(ends, ends_soon, side="left") + 1

        def dense(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order[0]] = 0
            rank[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
            return rank

        rank = dense(dense(packed) * (len(ends) + 1) + tie)
        while (most := int(rank.max())) < n - 1:
            # suffixes that end within the first part are told apart by it already
            rank = dense(rank * (most + 2) + np.where(left > depth, rank[np.minimum(where + depth, n - 1)], 0))
            depth *= 2
        return rank

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes, up to `length`, on which the strings from places a and b on agree."""
        found, live = np.full(len(a), self.length), np.arange(len(a))
        most = len(self.packed) - 1
        for k in range(0, self.length, 7):
            differ = self.packed[np.minimum(a[live] + k, most)] ^ self.packed[np.minimum(b[live] + k, most)]
            apart = np.flatnonzero(differ)
            found[live[apart]] = k + sum((differ[apart] >> 9 * j == 0).astype(np.int64) for j in range(7))
            live = live[differ == 0]
            if not len(live):
                break
        return np.minimum(np.minimum(found, self.length), np.minimum(self.left[a], self.left[b]) - 1)

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all strings, streamed in step from their ends backwards: places, ranks, and the bytes (up to `length`) that
        the suffix at each place has in common with the one ranked before it.

        Within a run both step back over the same symbol, so a match grows by one. At a run's head the suffix before it leaves; the next
        one to step back over the symbol is the last of the symbol's run before, whose sample gives the place to match against.
        """
        known = np.flatnonzero(self.before >= 0)
        at_head = np.zeros(len(self.head), np.int64)
        at_head[known] = np.minimum(self.agreement(self.first_sample[known], self.last_sample[self.before[known]]) + 1, self.length)
        rank, at, matched = self.end_rank.copy(), self.ends.copy(), np.zeros(len(self.ends), np.int64)
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        live = np.flatnonzero(at > self.starts)
        while len(live):
            run = np.searchsorted(self.head, rank[live], side="right") - 1
            step = rank[live] - self.head[run]
            matched[live] = np.where(step == 0, at_head[run], np.minimum(matched[live] + 1, self.length))
            rank[live] = self.goes[run] + step
            at[live] -= 1
            found.append((at[live], rank[live], matched[live]))
            live = live[at[live] > self.starts[live]]
        return tuple(np.concatenate(x) for x in zip(*found))


def repeats_among(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in their order in the corpus: the strings that also start earlier in them, as numbers of contexts and starts, in order.
    Neighbours in rank that match on length bytes have the same string there; the first place of such a stretch stays."""
    index = RunIndex(contexts, length)
    places, ranks, matched = index.stream()
    by_rank = np.zeros(len(index.left), np.int64)
    by_rank[ranks] = places + 1
    apart = np.ones(len(index.left), bool)
    apart[ranks] = matched < length
    stretch, place = np.cumsum(apart), by_rank - 1
    # stretches of one suffix have nothing to say
    shared = np.flatnonzero(~apart | ~np.append(apart[1:], True))
    place, stretch = place[shared], stretch[shared]
    whole = (place >= 0) & (index.left[place] > length)
    place, stretch = place[whole], stretch[whole]
    first = np.full(int(stretch.max(initial=0)) + 1, len(index.left))
    np.minimum.at(first, stretch, place)
    hit = np.sort(place[place != first[stretch]])
    owner = np.searchsorted(index.ends, hit, side="left")
    return owner, hit - index.starts[owner]


def merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places, adjacent ones joined."""
    if not len(start):
        return start, size
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate((start + size)[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    begin = start[new]
    return begin, reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] - begin


def place_column(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """doc (a long, in the order of the documents, unique), text, rest (the other columns)."""
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("rest"))
    n, distinct, known = rows.agg(F.count("*"), F.countDistinct("id"), F.count("id")).first()
    k = F.coalesce(F.col("id").cast("bigint"), F.lit(-(2**63)))
    if n == distinct == known:
        return rows.select(k.alias("doc"), "text", "rest")
    ranged = rows.withColumns({"k": k, "z": F.xxhash64("text")}).repartitionByRange("k", "z").sortWithinPartitions("k", "z")
    return write_table(ranged.select(F.monotonically_increasing_id().alias("doc"), "text", "rest"), "ordered-documents")


def layout(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and where each value begins and ends."""
    values = part.to_pylist()
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
    return np.frombuffer(b"".join(values), np.uint8), ends - np.fromiter(map(len, values), np.int64, len(values)), ends


#: A place as it is packed: document, start of a string in it.
PLACE = np.dtype([("doc", "<i8"), ("start", "<u4")])


def anchors(placed: DataFrame, length: int, kmer: int) -> DataFrame:
    """h, n, places (packed) of each anchor in a block of documents: one row, however often it occurs there, so no hash is a hot key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                data, starts, ends = layout(part.column(1))
                hashes, begin, _, _ = governed(data, starts, ends, length, kmer)
                owner = np.searchsorted(ends, begin, side="right")
                order = np.argsort(hashes, kind="stable")
                hashes, begin, owner = hashes[order], begin[order], owner[order]
                places = np.empty(len(begin), PLACE)
                places["doc"], places["start"] = np.asarray(part.column(0), np.int64)[owner], begin - starts[owner]
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
                bounds = np.r_[first, len(hashes)].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds * np.int32(PLACE.itemsize)), pa.py_buffer(places.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), packed], names=["h", "n", "places"])

    return placed.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(find, "h long, n int, places binary")


def unpacked(found: DataFrame) -> DataFrame:
    """doc, start of packed places."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.frombuffer(b"".join(batch.column(0).to_pylist()), PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(places["doc"].copy()), pa.array(places["start"].astype(np.int64))], names=["doc", "start"])

    return found.select("places").mapInArrow(unpack, "doc long, start long")


def contexts_of(texts: DataFrame, length: int, kmer: int) -> DataFrame:
    """texts has doc, packed (the text, compressed), marks (first starts of the anchors that recur). Gives rows of two kinds: 0 spans to
    remove, 1 contexts (h, doc, start, at: the anchor's place from the start on, data)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES // 2):
                ids = np.asarray(part.column(0), np.int64)
                data, starts, ends = layout(pa.array([zlib.decompress(x) for x in part.column(1).to_pylist()], pa.binary()))
                marks = part.column(2)
                many = np.asarray(marks.value_lengths(), np.int64)
                marked = np.sort(np.asarray(marks.flatten(), np.int64) + np.repeat(starts, many))
                hashes, begin, count, place = governed(data, starts, ends, length, kmer)
                spot = np.minimum(np.searchsorted(marked, begin), max(len(marked) - 1, 0))
                known = marked[spot] == begin if len(marked) else np.zeros(len(begin), bool)
                keep = np.flatnonzero(known)
                low, own = begin[keep], hashes[keep].view(np.int64)
                high = low + count[keep] - 1
                owner = np.searchsorted(ends, low, side="right")
                doc, start, at = ids[owner], low - starts[owner], place[keep] - low
                first: dict[bytes, int] = {}
                gone = []
                raw = data.tobytes()
                for i, context in enumerate([raw[a:b] for a, b in zip(low.tolist(), (high + length).tolist())]):
                    j = first.setdefault(context, i)
                    if j != i:
                        if (doc[i], start[i]) < (doc[j], start[j]):
                            first[context] = i
                            i = j
                        gone.append(i)
                gone = np.array(gone, np.int64)
                apart = starts + np.arange(len(starts))  # one place between texts, so that no span reaches into the next
                begins, sizes = merged((low + owner)[gone], (high + length - low)[gone])
                owner = np.searchsorted(apart, begins, side="right") - 1
                held = np.fromiter(first.values(), np.int64, len(first))
                n, m = len(owner), len(held)
                none = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])),
                        pa.array(np.concatenate([ids[owner], doc[held]])),
                        pa.array(np.concatenate([begins - apart[owner], start[held]])),
                        pa.concat_arrays([pa.array(sizes), none(m, pa.int64())]),
                        pa.concat_arrays([none(n, pa.int64()), pa.array(own[held])]),
                        pa.concat_arrays([none(n, pa.int32()), pa.array(at[held].astype(np.int32))]),
                        pa.concat_arrays([none(n, pa.binary()), pa.array(list(first), pa.binary())]),
                    ],
                    names=["kind", "doc", "start", "size", "h", "at", "data"],
                )

    return texts.mapInArrow(find, "kind int, doc long, start long, size long, h long, at int, data binary")


def index_spans(contexts: DataFrame, length: int) -> DataFrame:
    """doc, start, size of the spans to remove from contexts (h, doc, start, data) that meet by anchor."""

    def settle(groups: list[list[tuple]]) -> pa.RecordBatch:
        out, different = [], []
        for rows in groups:
            first: dict[bytes, tuple] = {}
            for doc, start, data in rows:
                if data in first:
                    out.append((doc, start, len(data)))
                else:
                    first[data] = (doc, start)
            if len(first) > 1:
                different += [(data, *where) for data, where in first.items()]
        owner, begin = repeats_among([d for d, _, _ in different], length)
        # strings of a context that follow or overlap each other are one span
        fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] > begin[:-1] + length)]) if len(owner) else owner
        size = begin[np.r_[fresh[1:] - 1, len(owner) - 1]] + length - begin[fresh] if len(owner) else begin
        out += [(different[i][1], different[i][2] + b, n) for i, b, n in zip(owner[fresh].tolist(), begin[fresh].tolist(), size.tolist())]
        columns = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "start", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        held, last = 0, None
        for batch in batches:
            for h, doc, start, data in zip(*[c.to_pylist() for c in batch.columns]):
                if h != last:
                    if held > INDEX_BYTES:
                        yield settle(groups)
                        groups, held = [], 0
                    groups.append([])
                    last = h
                groups[-1].append((doc, start, data))
                held += len(data)
        yield settle(groups)

    dealt = contexts.select("h", "doc", "start", "data").repartition("h").sortWithinPartitions("h", "doc", "start")
    return dealt.mapInArrow(read, "doc long, start long, size long")


def split_contexts(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts of crowded anchors cut by where the anchor lies in their strings, `width` places together: all strings of a cut hold the same
    longer run of bytes around the anchor, whose hash is the cut's anchor. Rows of two kinds as contexts_of() gives them; of equal cuts of a
    batch the first goes on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple[int, bytes], tuple] = {}
            gone = []
            for h, doc, start, at, data in zip(*[c.to_pylist() for c in batch.columns]):
                least = at - (len(data) - length)  # the anchor's place in the last string; in the first it is `at`
                for k in range(least // width, at // width + 1):
                    low, high = max(k * width, least), min(k * width + width - 1, at)
                    longer = data[at - k * width : at - (k * width + width - 1) + length]
                    key = xxhash.xxh64_intdigest(longer, (h + k) & 2**64 - 1) - 2**63, data[at - high : at - low + length]
                    row = (doc, start + at - high, high)
                    if key in first:
                        row, late = min(row, first[key]), max(row, first[key])
                        gone.append((*late[:2], len(key[1])))
                    first[key] = row
            rows = [(0, d, s, n, None, None, None) for d, s, n in gone] + [(1, d, s, None, h, at, own) for (h, own), (d, s, at) in first.items()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "doc", "start", "size", "h", "at", "data"])

    return contexts.select("h", "doc", "start", "at", "data").mapInArrow(cut, "kind int, doc long, start long, size long, h long, at int, data binary")


def deal(contexts: DataFrame, length: int, kmer: int, crowded: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans to remove, and contexts whose anchors are not crowded. Those of crowded anchors are cut, equal cuts are settled by grouping, and
    the others are looked at again: each time half as many strings of a context share a longer anchor, down to one, which is the string."""
    spans, done, width = [], [], length - kmer + 1
    while width > 1:
        full = contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("h")
        many = full.count()
        if not many:
            break
        full = F.broadcast(full) if many <= 10_000 else full.hint("merge")
        done.append(contexts.join(full, "h", "left_anti"))
        width = -(-width // 2)
        kinds = write_table(split_contexts(contexts.join(full, "h", "left_semi"), length, width), "cut-contexts", "zstd")
        cuts = kinds.where("kind = 1").select("h", "doc", "start", "at", "data")
        first = write_table(cuts.groupBy("h", "data").agg(F.min(F.struct("doc", "start", "at")).alias("first")).select("h", "first.*", "data"), "first-cuts", "zstd")
        where = first.select("h", "data", F.col("doc").alias("a"), F.col("start").alias("b"))
        others = cuts.join(where.hint("merge"), ["h", "data"]).where("doc != a OR start != b")
        spans += [kinds.where("kind = 0").select("doc", "start", "size"), others.select("doc", "start", F.octet_length("data").cast("long").alias("size"))]
        contexts = first
    return spans, [*done, contexts]


def squeeze(texts: DataFrame) -> DataFrame:
    """doc, packed: texts compressed for their way between tasks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(x, 2) for x in part.column(1).to_pylist()], pa.binary())], names=["doc", "packed"])

    return texts.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "doc long, packed binary")


def repeated_spans(placed: DataFrame, length: int = LENGTH, kmer: int = KMER, crowded: int = CROWDED) -> DataFrame:
    """doc, spans (start, size; may overlap) of the documents that lose bytes. placed has doc and text."""
    kmer = min(kmer, length)
    everywhere = F.sum("n").over(Window.partitionBy("h"))
    often = anchors(placed, length, kmer).withColumn("all", everywhere).where(F.col("all") > 1)
    hits = write_table(unpacked(often), "recurring-anchors", "zstd")
    marks = hits.groupBy("doc").agg(F.collect_list("start").alias("marks"))
    texts = squeeze(placed.where(F.octet_length("text") >= length)).join(marks.hint("merge"), "doc").select("doc", "packed", "marks")
    kinds = write_table(contexts_of(texts, length, kmer), "contexts", "zstd")
    spans, contexts = deal(kinds.where("kind = 1").select("h", "doc", "start", "at", "data"), length, kmer, crowded)
    spans = reduce(DataFrame.unionByName, [kinds.where("kind = 0").select("doc", "start", "size"), *spans, index_spans(reduce(DataFrame.unionByName, contexts), length)])
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def kept_bytes(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, in how many runs."""
    begin, size = merged(np.array([s["start"] for s in spans], np.int64), np.array([s["size"] for s in spans], np.int64))
    left, at = [], 0
    for b, n in zip(begin.tolist(), size.tolist()):
        left.append(text[at:b])
        at = b + n
    return b"".join([*left, text[at:]]), int(size.sum()), len(begin)


def with_spans(placed: DataFrame, length: int, kmer: int, crowded: int) -> DataFrame:
    spans = write_table(repeated_spans(placed, length, kmer, crowded), "spans", "zstd")
    return squeeze(placed).join(spans.hint("merge"), "doc", "left").select("doc", "packed", "spans")


def repeat_facts(docs: DataFrame, identity: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, crowded: int = CROWDED) -> DataFrame:
    """identity, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    placed = place_column(docs, identity, text)
    ids = placed.select("doc", F.col("rest")[identity].alias(identity))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, packed, spans in zip(*[c.to_pylist() for c in batch.columns]):
                whole = zlib.decompress(packed)
                left, gone, runs = kept_bytes(whole, spans) if spans else (whole, 0, 0)
                out.append((doc, len(whole), gone, runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    facts = with_spans(placed, length, kmer, crowded).mapInArrow(digest, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return facts.join(ids, "doc").select(identity, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame, identity: str = "doc_id", text: str = "text", chars: str = "n_chars", length: int = LENGTH, kmer: int = KMER, crowded: int = CROWDED) -> DataFrame:
    """docs with the repeated passages taken out of the text (and chars, if it is a column, counted anew). Of a character whose bytes a passage
    cuts, nothing stays. Rows that lose all their text go."""
    placed = place_column(docs, identity, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, texts = [], []
            for doc, packed, spans in zip(*[c.to_pylist() for c in batch.columns]):
                whole = zlib.decompress(packed)
                left = kept_bytes(whole, spans)[0].decode(errors="ignore") if spans else whole.decode()
                if left or not whole:
                    docs_.append(doc)
                    texts.append(left)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])

    left = with_spans(placed, length, kmer, crowded).mapInArrow(cut, "doc long, text string")
    joined = placed.select("doc", "rest").join(left, "doc")
    counted = {chars: F.length("text").cast(dict(docs.dtypes)[chars])} if chars in docs.columns else {}
    return joined.select(*[F.col("text").alias(text) if c == text else counted[c].alias(c) if c in counted else F.col("rest")[c].alias(c) for c in docs.columns])


def op4_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeat_facts(read_table(spark, sf_dir, "documents"))
