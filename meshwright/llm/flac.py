"""Bytes as FLAC media: encode, read back with checks, PCM blocks and features.

A payload is 8-bit mono samples in frames of 576. The encoder takes for each frame the fixed linear predictor (order 0 to 4)
and the Rice parameter that cost least; the decoder reads Rice residuals and linear predictors (fixed and quantised LPC, constant
and verbatim subframes), restores the samples and verifies the CRC-8 of each header and the CRC-16 of each frame, and the stream's
MD5. Both work on all frames of a block at once, one sample position at a time, so the cost of Python is shared by thousands of
frames. Each frame is a PCM block with its sample offset, and a seek table in the stream names the offsets.

Defined cases: a null or empty text becomes one frame of 255s, a very long one is coded MOST_FRAMES frames at a time, equal texts give equal media, repeated rows each get a row, extra
columns are dropped, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, text_or_empty, write_table

BLOCK = 576
RATE = 8000
PAD = 255
#: Payload bytes of short texts that a task codes at a time, and frames (of one long text, too) that are coded or decoded side by side.
GROUP_BYTES = 2 << 20
MOST_FRAMES = 4096
#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: A seek point for every second frame: a trade-off between the size of the seek table and the frames to decode before a sample.
SEEK_EVERY = 2


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def ragged_crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of data[start:start + size] for all pairs at once."""
    crc = np.zeros(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    at, left, value = starts[order], sizes[order], crc
    mask = np.uint32((1 << bits) - 1)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    for k, n in enumerate(live.tolist()):
        byte = data[at[:n] + k]
        value[:n] = (value[:n] << np.uint32(8) & mask) ^ table[(value[:n] >> np.uint32(bits - 8)) ^ byte]
    crc = np.empty_like(value)
    crc[order] = value
    return crc


def utf8_number(n: int) -> bytes:
    """A frame number in the coding that frame headers use."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit = 0x20 if limit == 0x40 else limit >> 1
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def residuals(samples: np.ndarray, order: int) -> np.ndarray:
    """What the fixed predictor of an order leaves of each row; the first samples stay."""
    out = samples.copy()
    for k in range(order):
        out[:, k + 1 :] = out[:, k + 1 :] - out[:, k:-1]
    out[:, :order] = samples[:, :order]
    return out


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """A FLAC frame for each row of samples (signed, 8 bits)."""
    frames, n = samples.shape
    candidates = [residuals(samples.astype(np.int32), o) for o in range(5)]
    costs = []
    for o, r in enumerate(candidates):
        folded = np.where(r < 0, -2 * r - 1, 2 * r)[:, o:]
        each = np.stack([(folded >> k).sum(1) + (k + 1) * (n - o) for k in range(15)])
        costs.append(each + 8 * o + 6)
    costs = np.stack(costs)  # order, parameter, frame
    best = costs.reshape(75, frames).argmin(0)
    order, rice = best // 15, best % 15
    chosen = np.stack(candidates)[order, np.arange(frames)]
    column = np.arange(n)
    warm = column < order[:, None]
    folded = np.where(chosen < 0, -2 * chosen - 1, 2 * chosen)
    k = rice[:, None]
    head = [b"\xff\xf8" + bytes([0x24, 0x02]) + utf8_number(int(i)) for i in numbers]
    head_bytes = np.frombuffer(b"".join(head), np.uint8)
    sizes = np.fromiter(map(len, head), np.int64, frames)
    check = ragged_crc(head_bytes, np.cumsum(sizes) - sizes, sizes, CRC8, 8)
    # bits of the subframe: 8 for its type, warm-up samples, 10 for coding and parameter, then the residuals
    width = np.where(warm, 8, (folded >> k) + 1 + k)
    lead = np.where(column == order[:, None], 10, 0)  # coding method, partition order and parameter go before the first residual
    ends = np.cumsum(width + lead, 1) + 8
    bits = ends[:, -1]
    body = -(-bits // 8)
    offset = (np.cumsum(body) - body) * 8
    total = int(body.sum()) * 8
    plane = np.zeros(total, np.uint8)
    start = offset[:, None] + ends - width

    def put(at: np.ndarray, value: np.ndarray, size: int) -> None:
        for b in range(size):
            plane[at + b] = value >> (size - 1 - b) & 1

    put(offset, (8 + order) << 1, 8)
    put(start[warm], chosen[warm] & 0xFF, 8)
    put(offset + 8 + 8 * order, rice, 10)  # 00 0000 pppp
    cold = ~warm
    at = start[cold]
    stop = at + (folded >> k)[cold]
    plane[stop] = 1
    low, many = folded[cold], np.broadcast_to(k, folded.shape)[cold]
    for b in range(int(rice.max(initial=0))):
        ok = many > b
        plane[(stop + many - b)[ok]] = low[ok] >> b & 1
    packed = np.packbits(plane)
    parts = []
    at = np.cumsum(body) - body
    raw = packed.tobytes()
    for i in range(frames):
        parts.append(head[i] + bytes([int(check[i])]) + raw[at[i] : at[i] + body[i]])
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, frames)
    sums = ragged_crc(joined, np.cumsum(sizes) - sizes, sizes, CRC16, 16)
    return [p + int(c).to_bytes(2, "big") for p, c in zip(parts, sums)]


def stream_head(samples: int, sizes: list[int], digest: bytes) -> bytes:
    """The marker, STREAMINFO and a seek table: every so many frames a sample offset and a byte offset."""
    info = (BLOCK << 48 | BLOCK << 32).to_bytes(10, "big")[2:6] + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + digest
    points, at = b"", 0
    for i, n in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points += (i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big")
        at += n
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """The FLAC stream of each payload, whose size is a multiple of the block."""
    per = [len(p) // BLOCK for p in payloads]
    data = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(n) for n in per]) if per else np.zeros(0, np.int64)
    frames = [f for i in range(0, len(data), MOST_FRAMES) for f in encode_frames(data[i : i + MOST_FRAMES], numbers[i : i + MOST_FRAMES])]
    out, at = [], 0
    for p, n in zip(payloads, per):
        own = frames[at : at + n]
        pcm = data[at : at + n].astype(np.int8).tobytes()
        out.append(stream_head(len(p), [len(f) for f in own], hashlib.md5(pcm).digest()) + b"".join(own))
        at += n
    return out


def read_head(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """Samples, MD5, seek points (sample, byte) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, samples, digest, points = 4, 0, b"", []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            samples, digest = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            return samples, digest, points, at


def words_at(data: np.ndarray) -> np.ndarray:
    """For each byte the 8 bytes from there on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + len(word)]
    return word


#: Leading zeros of 16 bits.
ZEROS = 16 - np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int64)


class Bits:
    """A bit cursor for each of many frames over one array of bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.words = words_at(data)
        self.at = at.astype(np.int64)

    def window(self, who: np.ndarray | slice) -> np.ndarray:
        """57 bits and more from the cursor on, left-aligned."""
        at = self.at[who]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, size: int, who: np.ndarray | slice = slice(None)) -> np.ndarray:
        value = (self.window(who) >> np.uint64(64 - size)).astype(np.int64)
        self.at[who] += size
        return value

    def zeros(self, who: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is taken too."""
        found = ZEROS[(self.window(who) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(found == 16)
        while len(more):
            self.at[who[more]] += 16
            step = ZEROS[(self.window(who[more]) >> np.uint64(48)).astype(np.int64)]
            found[more] += step
            more = more[step == 16]
        self.at[who] += found % 16 + 1
        return found

    def rice(self, parameter: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Signed Rice codes with a parameter for each frame."""
        value = self.zeros(who) << parameter
        value |= (self.window(who) >> np.uint64(1) >> (63 - parameter).astype(np.uint64)).astype(np.int64)
        self.at[who] += parameter
        return (value >> 1) ^ -(value & 1)


def signed(value: np.ndarray, bits: int) -> np.ndarray:
    return value - ((value >> (bits - 1) & 1) << bits)


def decode_subframes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the mono frames whose subframes begin at these bytes (a row each), and the byte after each."""
    frames = len(at)
    bits = Bits(data, at * 8)
    kind = bits.take(8) >> 1
    out = np.zeros((BLOCK, frames), np.int64)
    every = np.arange(frames)
    constant, verbatim = every[kind == 0], every[kind == 1]
    if len(constant):
        out[:, constant] = signed(bits.take(8, constant), 8)
    for i in range(BLOCK if len(verbatim) else 0):
        out[i, verbatim] = signed(bits.take(8, verbatim), 8)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a subframe type that isn't known")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    coded = every[fixed | lpc]
    if not len(coded):
        return out.T, -(-bits.at // 8)
    most = int(order[coded].max())
    for i in range(most):
        own = coded[order[coded] > i]
        out[i, own] = signed(bits.take(8, own), 8)
    weights, shift = np.zeros((max(most, 1), frames), np.int64), np.zeros(frames, np.int64)
    for o in range(1, min(4, most) + 1):
        weights[:o, fixed & (order == o)] = np.array(FIXED[o])[:, None]
    quantised = every[lpc]
    precision = bits.take(4, quantised) + 1
    shift[quantised] = signed(bits.take(5, quantised), 5)
    for size in np.unique(precision).tolist():
        own = quantised[precision == size]
        for j in range(int(order[own].max())):
            more = own[order[own] > j]
            weights[j, more] = signed(bits.take(size, more), size)
    method, depth = bits.take(2, coded), bits.take(4, coded)
    wide, parts = np.where(method == 0, 4, 5), BLOCK >> depth
    begins = [set(np.flatnonzero(np.arange(BLOCK) % p == 0).tolist()) for p in np.unique(parts)]
    changes = set().union(*begins) | set(order[coded].tolist())
    rice, plain = np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    predicted = coded[order[coded] > 0]
    for i in range(BLOCK):
        own = coded if i >= most else coded[order[coded] <= i]
        if i in changes:
            fresh = ((i % parts == 0) & (i >= order[coded])) | (i == order[coded])
            for size in (4, 5):
                new = coded[fresh & (wide == size)]
                if len(new):
                    value = bits.take(size, new)
                    escape = value == (1 << size) - 1
                    rice[new] = np.where(escape, -1, value)
                    if escape.any():
                        plain[new[escape]] = bits.take(5, new[escape])
            steady = not (rice[coded] < 0).any()
        if not len(own):
            continue
        if steady:
            out[i, own] = bits.rice(rice[own], own)
        else:
            good = own[rice[own] >= 0]
            out[i, good] = bits.rice(rice[good], good)
            for w in own[rice[own] < 0].tolist():
                if plain[w]:
                    out[i, w] = signed(bits.take(int(plain[w]), np.array([w])), int(plain[w]))[0]
        back = predicted if i >= most else predicted[order[predicted] <= i]
        if len(back):
            guess = np.zeros(len(back), np.int64)
            for j in range(min(most, i)):
                guess += weights[j, back] * out[i - 1 - j, back]
            out[i, back] += guess >> shift[back]
    return out.T, -(-bits.at // 8)


def decode_segments(data: np.ndarray, who: np.ndarray, at: np.ndarray, sample: np.ndarray, end: np.ndarray, stop: np.ndarray, blocks: list[dict[int, bytes]]) -> None:
    """Decode the frames from byte `at` to `stop`, of samples from `sample` to `end` of stream `who`, for all segments side by side, into blocks."""
    high = int(stop.max())
    while len(at):
        if not ((data[at] == 0xFF) & (data[at + 1] == 0xF8)).all():
            raise ValueError("no frame where one should be")
        lead = data[at + 4]
        more = np.where(lead < 0x80, 0, 7 - np.frexp((~lead).astype(np.uint8).astype(float))[1])
        size = 5 + np.where(lead < 0x80, 0, more)
        if (ragged_crc(data, at, size, CRC8, 8) != data[at + size]).any():
            raise ValueError("a frame header's checksum does not hold")
        # the bytes that these segments need, not those of the whole stream
        low = int(at.min())
        out, after = decode_subframes(data[low:high], at + size + 1 - low)
        after = after + low
        if (ragged_crc(data, at, after - at, CRC16, 16) != data[after].astype(np.uint32) << 8 | data[after + 1]).any():
            raise ValueError("a frame's checksum does not hold")
        pcm = (out + 128).astype(np.uint8)
        for k, (i, s) in enumerate(zip(who.tolist(), sample.tolist())):
            blocks[i][s] = pcm[k].tobytes()
        sample = sample + BLOCK
        going = sample < end
        who, at, sample, end = who[going], (after + 2)[going], sample[going], end[going]


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, bytes) of each stream; raises ValueError where a checksum or the MD5 does not hold."""
    heads = [read_head(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    # frames of one stream follow each other; those of all streams are decoded side by side from their seek points
    blocks: list[dict[int, bytes]] = [{} for _ in streams]
    who, at, sample, end, stop = [], [], [], [], []
    for i, (samples, _, points, begin) in enumerate(heads):
        for j, (first, byte) in enumerate(points):
            who.append(i)
            at.append(base[i] + begin + byte)
            sample.append(first)
            end.append(points[j + 1][0] if j + 1 < len(points) else samples)
            stop.append(base[i] + begin + points[j + 1][1] if j + 1 < len(points) else base[i + 1])
    every = [np.array(x, np.int64) for x in (who, at, sample, end, stop)]
    for first in range(0, len(every[0]), MOST_FRAMES):
        decode_segments(data, *[x[first : first + MOST_FRAMES] for x in every], blocks)
    found = [sorted(b.items()) for b in blocks]
    for (samples, digest, _, _), own in zip(heads, found):
        joined = b"".join(b for _, b in own)
        if len(joined) != samples or hashlib.md5((np.frombuffer(joined, np.uint8).astype(np.int16) - 128).astype(np.int8).tobytes()).digest() != digest:
            raise ValueError("the stream's MD5 does not hold")
    return found


def payload(text: bytes) -> bytes:
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text.ljust(size, bytes([PAD]))


def features(pcm: bytes) -> str:
    """Mean level, root mean square about it, zero crossings and spectral centroid of the samples, to four places."""
    x = np.frombuffer(pcm, np.uint8)
    power, total, squares, crossings, step = np.zeros(BLOCK // 2 + 1), 0, 0, 0, BLOCK * 64
    for i in range(0, len(x), step):
        part = x[i : i + step].astype(np.int64) - 128
        rows = part.reshape(-1, BLOCK)
        power += (np.abs(np.fft.rfft(rows - rows.mean(1, keepdims=True), axis=1)) ** 2).sum(0)
        total, squares = total + int(part.sum()), squares + int((part * part).sum())
        above = x[i : i + step + 1] >= 128
        crossings += int((above[1:] != above[:-1]).sum())
    mean, energy = total / len(x), power.sum()
    centroid = float((power * np.arange(len(power))).sum() / energy) * RATE / BLOCK if energy > 0 else 0.0
    return f"mean={mean:.4f};rms={max(squares / len(x) - mean * mean, 0.0) ** 0.5:.4f};crossings={crossings};centroid={centroid:.2f}"


def to_media(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """identity, n_bytes and media (a FLAC stream) of each row."""
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).cast("binary").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, GROUP_BYTES):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(store, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", identity)


def pcm_blocks(media: DataFrame, identity: str = "doc_id", column: str = "media") -> DataFrame:
    """identity, sample_offset, pcm of each block of each stream."""
    rows = media.select(F.col(identity).alias("id"), F.col(column).alias("media"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, GROUP_BYTES):
                found = [(i, *b) for i, own in zip(part.column(0).to_pylist(), decode(part.column(1).to_pylist())) for b in own]
                ids, offsets, pcm = zip(*found) if found else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), pa.array(offsets, pa.int64()), pa.array(pcm, pa.binary())], names=["id", "sample_offset", "pcm"])

    return rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, sample_offset long, pcm binary").withColumnRenamed("id", identity)


def write_pcm(media: DataFrame, identity: str = "doc_id", column: str = "media") -> DataFrame:
    """pcm_blocks() as a written table in order of stream and sample, so that a range of samples is found by the files' own statistics."""
    blocks = pcm_blocks(media, identity, column)
    return write_table(blocks.repartitionByRange(identity, "sample_offset").sortWithinPartitions(identity, "sample_offset"), "pcm-blocks", "zstd")


def media_facts(media: DataFrame, identity: str = "doc_id") -> DataFrame:
    """identity, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""
    rows = media.select(F.col(identity).alias("id"), "n_bytes", "media")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, GROUP_BYTES):
                streams = part.column(2).to_pylist()
                pcm = [b"".join(b for _, b in own) for own in decode(streams)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(map(len, pcm), pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in pcm], pa.string()),
                        pa.array([zlib.crc32(p[-32:]) for p in pcm], pa.int64()),
                        pa.array(map(len, streams), pa.int64()),
                        pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                        pa.array([features(p) for p in pcm], pa.string()),
                    ],
                    names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", identity)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every document's FLAC form, computed from the stored bytes."""
    media = write_table(to_media(read_table(spark, sf_dir, "documents")), "media")
    return media_facts(media)
