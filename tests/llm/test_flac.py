import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import flac


def back(streams):
    out = {}
    for owner, first, samples in flac.decode_all(streams):
        assert len(out.get(owner, b"")) == first
        out[owner] = out.get(owner, b"") + (samples[0] + 128).astype(np.uint8).tobytes()
    return [out[i] for i in range(len(streams))]


PAYLOADS = [b"\0" * 64, b"abc" * 5000, np.random.default_rng(1).integers(0, 256, 10_000, dtype=np.uint8).tobytes(), bytes(i % 256 for i in range(5000)), b"x", "héllo wörld ".encode() * 900, bytes([128] * 4096 + [0, 255] * 3000)]


def test_round_trip():
    streams = flac.encode_all(PAYLOADS)
    assert back(streams) == PAYLOADS
    assert len(streams[5]) < len(PAYLOADS[5])


def test_without_seek_table():
    stripped = []
    for s in flac.encode_all(PAYLOADS):
        seek = int.from_bytes(s[43:46], "big")
        stripped.append(s[:4] + b"\x80" + s[5:42] + s[46 + seek :])
    assert back(stripped) == PAYLOADS


@pytest.mark.parametrize("at", [30, -1, -20, 60])
def test_damage_is_found(at):
    s = bytearray(flac.encode_all([PAYLOADS[5]])[0])
    s[at] ^= 0x10
    with pytest.raises((flac.Corrupt, IndexError)):
        back([bytes(s)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - j)) & 1 for j in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def lpc_stream(samples, coefficients, shift, partitions=2, raw_partition=None, bits=16):
    """A stream of one frame by a linear predictor, its residual in 2^partitions partitions, one of them escaped to raw bits."""
    order, n = len(coefficients), len(samples)
    residual = [samples[t] - (sum(c * samples[t - 1 - j] for j, c in enumerate(coefficients)) >> shift) for t in range(order, n)]
    b = Bits()
    b.put((0x20 | (order - 1)) << 1, 8)
    for s in samples[:order]:
        b.put(s & ((1 << bits) - 1), bits)
    b.put(14, 4)
    b.put(shift, 5)
    for c in coefficients:
        b.put(c & 0x7FFF, 15)
    b.put(0, 2)
    b.put(partitions, 4)
    at, each = 0, n >> partitions
    for p in range(1 << partitions):
        part = residual[at : at + each - (order if p == 0 else 0)]
        at += len(part)
        if p == raw_partition:
            b.put(15, 4)
            b.put(18, 5)
            for e in part:
                b.put(e & ((1 << 18) - 1), 18)
            continue
        k = 5
        b.put(k, 4)
        for e in part:
            z = e << 1 if e >= 0 else (-e << 1) - 1
            b.bits += [0] * (z >> k) + [1]
            b.put(z & ((1 << k) - 1), k)
    head = b"\xff\xf8\x70\x08" + b"\x00" + (n - 1).to_bytes(2, "big")
    body = head + bytes([flac.crc8(head)]) + b.bytes()
    crc = int(flac.crc16_of(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    frame = body + crc.to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | ((bits - 1) << 36) | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


@pytest.mark.parametrize("raw", [None, 1])
def test_linear_prediction_and_partitions(raw):
    t = np.arange(1024)
    samples = (8000 * np.sin(t / 9) + 500 * np.sin(t * 1.7)).astype(int).tolist()
    stream = lpc_stream(samples, [15000, -7500], 13, raw_partition=raw)
    (owner, first, got), = flac.decode_all([stream])
    assert (owner, first) == (0, 0) and got[0].tolist() == samples


def test_long_unary_runs():
    samples = [0, 1, 20000, -20000, 5] * 40
    (_, _, got), = flac.decode_all([lpc_stream(samples[:128], [1], 0, partitions=0)])
    assert got[0].tolist() == samples[:128]


def test_linear_prediction_in_lanes_of_several_sizes():
    t = np.arange(1024)
    waves = [(a * np.sin(t[:n] / 9) + 500 * np.sin(t[:n] * 1.7)).astype(int).tolist() for a, n in ((8000, 1024), (300, 512), (9000, 64), (20, 1024))]
    got = {o: s[0].tolist() for o, _, s in flac.decode_all([lpc_stream(w, [15000, -7500], 13, partitions=0) for w in waves])}
    assert got == dict(enumerate(waves))


def test_table(spark):
    docs = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (3, "", 3), (4, "abc", 4), (5, "é" * 70_000, 5), (1, "abc", 1), (None, "x", 6)], "doc_id bigint, text string, media int")
    media = flac.encode_documents(docs)
    stored = flac.stored_blocks(media)
    assert any("pcm-blocks" in f for f in stored.inputFiles())
    rows = {r.doc_id: r for r in flac.block_digests(stored).collect()}
    assert len(rows) == 6 and flac.block_digests(stored).count() == 7
    assert rows[1].feature == rows[4].feature and rows[1].media_sha256 == rows[4].media_sha256 and rows[1].flac_sha256 == rows[4].flac_sha256
    assert (rows[2].n_bytes, rows[2].payload_bytes, rows[5].payload_bytes) == (0, 64, 140_032)
    for i, text in ((1, "abc"), (2, ""), (5, "é" * 70_000)):
        payload = flac.padded(text.encode())
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        assert (rows[i].payload_sha256, rows[i].tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(payload), hashlib.sha256(signed).hexdigest())
    blocks = flac.pcm_blocks(stored).where("doc_id = 5").orderBy("first_sample").collect()
    assert [b.first_sample for b in blocks] == list(range(0, 140_032, 4096)) and sum(b.n_samples for b in blocks) == 140_032
    whole = (np.frombuffer(flac.padded(("é" * 70_000).encode()), np.uint8) ^ 0x80).tobytes()
    parts = sorted((r.first_sample, bytes(r.pcm)) for r in flac.samples_at(stored.where("doc_id = 5"), 5000, 9000).collect())
    assert [p[0] for p in parts] == [5000, 8192, 12288] and b"".join(p[1] for p in parts) == whole[5000:14_000]
    assert flac.block_digests(flac.stored_blocks(flac.encode_documents(docs.where("false")))).count() == 0


def test_stored_damage_is_found(spark):
    stored = flac.stored_blocks(flac.encode_documents(spark.createDataFrame([(1, "abc " * 3000)], "doc_id bigint, text string")))
    moved = stored.withColumn("blocks", F.reverse("blocks"))
    with pytest.raises(Exception, match="stored blocks miss"):
        flac.block_digests(moved).collect()


def test_null_media_and_other_columns(spark):
    media = spark.createDataFrame([(1, None, "t")], "doc_id bigint, media binary, pcm string")
    assert flac.pcm_blocks(flac.stored_blocks(media)).count() == 0


def test_streams_of_the_query_hold_linear_predictors(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    linear = frames = plain = coded = 0
    for r in flac.encode_documents(docs).where("n_bytes > 2000").limit(40).collect():
        info, ranges = flac.split_stream(bytes(r.media))
        samples = sum(1 for _ in ranges)
        for i, (s, e) in enumerate(ranges):
            size = min(flac.BLOCK, -(-r.n_bytes // flac.PAD) * flac.PAD - i * flac.BLOCK)
            kind = r.media[s + len(flac.frame_header(i, size))] >> 1
            linear += kind >= 0x20
            frames += 1
            plain, coded = plain + size, coded + e - s
        assert samples
    assert linear > 0.5 * frames and coded < 0.96 * plain


def test_predictors_are_bounded():
    r = np.random.default_rng(3)
    wave = (100 * np.sin(np.arange(6000) / 9)).astype(np.int8).view(np.uint8) ^ 0x80
    loud = r.choice([0, 255], 6000).astype(np.uint8)
    payloads = [wave.tobytes(), loud.tobytes(), np.tile([0, 255, 255, 0, 128], 1500).astype(np.uint8).tobytes(), bytes([5] * 40), np.repeat([0, 255], 4000).astype(np.uint8).tobytes()]
    streams = flac.encode_all(payloads)
    assert back(streams) == payloads and len(streams[0]) < 0.5 * len(payloads[0])


def test_codes_are_placed_by_words():
    rng = np.random.default_rng(3)
    wide = rng.integers(1, 18, 4000)
    at = np.cumsum(wide + rng.integers(0, 90, 4000)) - wide
    value = (1 << (wide - 1)) | rng.integers(0, 1 << 20, 4000) % (1 << (wide - 1))
    n = int(at[-1] + wide[-1] + 7) // 8
    bits = np.zeros(n * 8, np.uint8)
    for a, v, w in zip(at.tolist(), value.tolist(), wide.tolist()):
        bits[a : a + w] = [(v >> (w - 1 - j)) & 1 for j in range(w)]
    assert (flac.placed_codes(at, value, wide, n) == np.packbits(bits)).all()


def test_streams_stay_as_they_were():
    text = b"".join(b"%d words and %d more, " % (i * i % 977, i) for i in range(3000))
    streams = flac.encode_all([*PAYLOADS, flac.padded(text)])
    assert hashlib.sha256(b"".join(streams)).hexdigest() == "6067b2d6f092370d54c269346cc6608c4e9a6c28e862d47313b6bd7065d1f7a4"
    assert back(streams) == [*PAYLOADS, flac.padded(text)]
