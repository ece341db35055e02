import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm import flac as X


def back(payloads):
    return [b"".join(b for _, b in own) for own in X.decode(X.encode(payloads))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_round_trip_of_any_bytes(texts):
    payloads = [X.payload(t) for t in texts]
    assert back(payloads) == payloads


def test_round_trip_of_smooth_noisy_long_and_jumping_samples():
    rng = np.random.default_rng(1)
    wave = (100 * np.sin(np.arange(3000) / 9) + 128).astype(np.uint8).tobytes()
    payloads = [X.payload(t) for t in (wave, bytes(range(256)) * 3, b"\x00" * 100_000, bytes([0, 255] * 400), rng.integers(0, 256, 5000, dtype=np.uint8).tobytes())]
    assert back(payloads) == payloads
    assert len(X.encode(payloads[:1])[0]) < 0.8 * len(payloads[0])


def test_damage_is_noticed():
    stream = X.encode([X.payload(b"some text " * 200)])[0]
    for at in (len(stream) - 300, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 8
        with pytest.raises(ValueError):
            X.decode([bytes(bad)])


def test_other_encoders_subframes():
    """Constant, verbatim and quantised linear prediction, written here bit by bit."""
    x = [3, 5, 8, 12, 17, 23] + [23] * 570
    lpc = f"{32 + 1:07b}0" + "".join(f"{v & 255:08b}" for v in x[:2]) + f"{5 - 1:04b}" + f"{0:05b}" + f"{2:05b}" + f"{-1 & 31:05b}" + "00" + "0001"
    rest = [x[i] - (2 * x[i - 1] - x[i - 2]) for i in range(2, len(x))]
    folded = [2 * r if r >= 0 else -2 * r - 1 for r in rest]
    for part, k in ((folded[:286], 1), (folded[286:], 0)):
        lpc += f"{k:04b}" + "".join("0" * (v >> k) + "1" + (f"{v & 1:01b}" if k else "") for v in part)
    plain = "00000010" + "".join(f"{v & 255:08b}" for v in x)
    same = "00000000" + f"{-7 & 255:08b}"
    escaped = "00010000" + "00" + "0000" + "1111" + "00110" + "".join(f"{v & 63:06b}" for v in x)
    bodies = []
    for bits in (lpc, plain, same, escaped):
        bits = bits.replace("None", "")
        bodies.append(bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)))
    starts = np.cumsum([0, *map(len, bodies)])
    out, after = X.decode_subframes(np.frombuffer(b"".join(bodies), np.uint8), starts[:-1])
    assert after.tolist() == starts[1:].tolist()
    assert out[0].tolist() == x and out[1].tolist() == x and out[2].tolist() == [-7] * 576 and out[3].tolist() == [v for v in x]


def test_facts_of_odd_rows(spark):
    texts = ["", None, "é" * 288, "a" * 577, "a" * 577, "long text " * 30_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = sorted(X.media_facts(X.to_media(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(texts)
    for r in got:
        text = (texts[3 if r.doc_id is None else r.doc_id] or "").encode()
        want = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    same = [r for r in got if r.n_bytes == 577]
    assert same[0][1:] == same[1][1:]
    assert X.media_facts(X.to_media(docs.limit(0))).collect() == []


def test_blocks_carry_sample_offsets(spark):
    docs = spark.createDataFrame([(1, "x" * 1500)], "doc_id long, text string")
    rows = sorted(X.pcm_blocks(X.to_media(docs)).collect(), key=lambda r: r.sample_offset)
    assert [r.sample_offset for r in rows] == [0, 576, 1152] and b"".join(bytes(r.pcm) for r in rows) == b"x" * 1500 + b"\xff" * 228


def test_long_payloads_are_coded_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    payloads = [X.payload(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (576 * 23, 576 * 2, 576 * 40 + 5)]
    whole = X.encode(payloads)
    monkeypatch.setattr(X, "MOST_FRAMES", 7)
    assert X.encode(payloads) == whole and back(payloads) == payloads


def test_written_blocks_are_found_by_sample(spark):
    docs = spark.createDataFrame([(i, chr(97 + i) * (1200 * i)) for i in range(4)], "doc_id long, text string")
    blocks = X.write_pcm(X.to_media(docs))
    (row,) = blocks.where("doc_id = 3 AND sample_offset <= 1000 AND sample_offset > 1000 - 576").collect()
    assert (row.sample_offset, bytes(row.pcm)) == (576, b"d" * 576) and blocks.count() == 1 + 3 + 5 + 7


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in X.op10_flac_media(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = (r.text or "").encode()
        want = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        x, g = np.frombuffer(want, np.uint8).astype(float) - 128, got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        told = dict(p.split("=") for p in g.feature.split(";"))
        assert abs(float(told["mean"]) - x.mean()) < 1e-3 and abs(float(told["rms"]) - x.std()) < 1e-3 and int(told["crossings"]) == int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
