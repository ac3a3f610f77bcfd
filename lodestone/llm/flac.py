"""FLAC media columns: encode bytes as 8-bit samples, decode Rice residuals and linear predictors, verify checksums, write PCM blocks.

Bit work is done for many frames at once: the encoder places all codes of a group with one cumulative sum, and the decoder
walks one code of every frame a step (a lane a frame), so no Python loop runs over samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, joined_bytes, map_arrow, slices, table

BLOCK = 4096
PAD = 64
#: Samples that the encoder's linear predictors look back, and the bits of their coefficients.
ORDER, PRECISION = 8, 12
GROUP_BYTES = 1 << 20

# Fixed values of the format: polynomials of the frame checksums and the codes of header fields.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
BITS_BY_CODE = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    values = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        values = np.where(values & top, (values << 1) ^ poly, values << 1) & mask
    return values


CRC8 = _crc_table(CRC8_POLY, 8).tolist()
CRC16 = _crc_table(CRC16_POLY, 16).astype(np.uint16)
_by_distance = CRC16[None, :]


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = CRC8[value ^ b]
    return value


def crc16_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch [start, end) of data. The CRC is linear: a byte's share depends on its value and distance from the end."""
    global _by_distance
    longest = int((ends - starts).max(initial=0))
    if longest > len(_by_distance):
        rows = [_by_distance[-1]]
        for _ in range(longest - len(_by_distance)):
            rows.append(((rows[-1] << np.uint16(8)) ^ CRC16[rows[-1] >> np.uint16(8)]).astype(np.uint16))
        _by_distance = np.concatenate([_by_distance, np.array(rows[1:], np.uint16)])
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
    share = _by_distance[np.repeat(ends, sizes) - 1 - at, data[at]]
    return np.bitwise_xor.reduceat(share, first)


def coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


def frame_header(number: int, size: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + coded_number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 15)).astype(np.uint16)


def predictors(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients in PRECISION bits, shift) of a linear predictor of ORDER samples for each frame, by Levinson's recursion on its autocorrelation."""
    v = x.astype(np.int32)  # a sum of BLOCK products of 8-bit samples stays below 2^27
    lags = [np.add.reduceat(v * v, starts)]
    product = np.empty_like(v)
    head = starts[:, None] + np.arange(ORDER)
    own = np.arange(ORDER) < sizes[:, None]
    for j in range(1, ORDER + 1):
        np.multiply(v[j:], v[:-j], out=product[j:])
        product[head[:, :j][own[:, :j]]] = 0
        lags.append(np.add.reduceat(product, starts))
    r = np.stack(lags, 1).astype(np.float64)
    c, error = np.zeros((len(sizes), ORDER)), np.maximum(r[:, 0], 1e-9) * (1 + 1e-9)
    for i in range(ORDER):
        reflect = (r[:, i + 1] - (c[:, :i] * r[:, i:0:-1]).sum(1)) / error
        c[:, :i], c[:, i] = c[:, :i] - reflect[:, None] * c[:, :i][:, ::-1], reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    top = np.maximum(np.abs(c).max(1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(np.int64), 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(c * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def rice_cost(z: np.ndarray, totals: np.ndarray, counted: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Rice parameter, bits) of each frame's residuals."""
    best = np.floor(np.log2(totals / counted + 1)).astype(np.int64)
    k, most = None, None
    for guess in (best, best - 1):
        guess = np.clip(guess, 0, 14)
        bits = np.add.reduceat(z >> np.repeat(guess, sizes).astype(np.uint16), starts, dtype=np.int64) + counted * (guess + 1)
        k, most = (guess, bits) if k is None else (np.where(bits < most, guess, k), np.minimum(bits, most))
    return k, most


def placed_codes(at: np.ndarray, value: np.ndarray, wide: np.ndarray, n_bytes: int) -> np.ndarray:
    """n_bytes bytes with each value's `wide` bits (32 at most) at bit at[i]; places ascend and do not overlap."""
    words = np.zeros(n_bytes // 4 + 2, np.uint32)
    if len(at):
        word = at >> 5
        window = value.view(np.uint64) << (64 - (at & 31) - wide).astype(np.uint64)  # the 64 bits from the word that a code begins in
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        word, window = word[first], np.bitwise_or.reduceat(window, first)
        words[word] = window >> np.uint64(32)
        words[word + 1] |= window.astype(np.uint32)
    return words.astype(">u4").view(np.uint8)[:n_bytes]


def encode_frames(data: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of consecutive stretches of unsigned bytes (sample = byte - 128), each constant, verbatim, of fixed order 0 to 2, or of a
    linear predictor, whichever is shortest, with one Rice partition."""
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    signed = data ^ 0x80
    x = signed.view(np.int8).astype(np.int16)
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    coded, totals = [zigzag(x)], []
    diff = x
    for order in (1, 2):
        diff = np.diff(diff, prepend=diff[:1]).astype(np.int16)
        diff[within < order] = 0
        coded.append(zigzag(diff))
    totals = np.stack([np.add.reduceat(c, starts, dtype=np.int64) for c in coded])
    constant = totals[1] == 0
    order = np.where(sizes > 2, totals.argmin(0), 0)
    z = coded[0]
    for o in (1, 2):
        if (order == o).any():
            z = np.where(np.repeat(order == o, sizes), coded[o], z)
    counted = np.maximum(1, sizes - order)
    z[within < np.repeat(order, sizes)] = 0
    k, most = rice_cost(z, totals[order, np.arange(n)], counted, starts, sizes)
    rice_bits = most + 18 + 8 * order

    weights, shift = predictors(x, starts, sizes)
    guess = np.zeros(len(x), np.int32)
    for j in range(ORDER):
        guess[j + 1 :] += np.repeat(weights[:, j].astype(np.int32), sizes)[j + 1 :] * x[: -j - 1]
    left = x - (guess >> np.repeat(shift, sizes).astype(np.int32))
    left[within < ORDER] = 0
    fits = (sizes > 4 * ORDER) & (np.maximum.reduceat(np.abs(left), starts) < 1 << 14)
    y = zigzag(left.astype(np.int16))
    ky, bits_y = rice_cost(y, np.add.reduceat(y, starts, dtype=np.int64), np.maximum(1, sizes - ORDER), starts, sizes)
    extra = 9 + PRECISION * ORDER
    linear = fits & ~constant & (bits_y + 18 + 8 * ORDER + extra < np.minimum(rice_bits, 8 * sizes + 8))
    extra = np.where(linear, extra, 0)
    order = np.where(linear, ORDER, order)
    k, rice_bits = np.where(linear, ky, k), np.where(linear, bits_y + 18 + 8 * ORDER + extra, rice_bits)
    z = np.where(np.repeat(linear, sizes), y, z)
    plain = ~constant & (rice_bits >= 8 * sizes + 8)
    rice = ~constant & ~plain
    order = np.where(rice, order, 0)
    body = np.where(constant, 2, np.where(plain, sizes + 1, (rice_bits + 7) // 8))
    heads = [frame_header(int(i), int(s)) for i, s in zip(numbers, sizes)]
    head_sizes = np.array([len(h) for h in heads])
    ends = np.cumsum(head_sizes + body + 2)
    begins = ends - head_sizes - body - 2
    bits = np.zeros(int(ends[-1]) * 8, np.uint8)
    codes_at = (begins + head_sizes) * 8 + 18 + 8 * order + extra
    at = ((begins + head_sizes) * 8 + 8 + 8 * ORDER)[linear]  # behind the first samples: precision, shift, coefficients
    fields = [(np.full(len(at), PRECISION - 1), 4), (shift[linear], 5), *[(weights[linear, j], PRECISION) for j in range(ORDER)]]
    for value, wide in fields:
        for j in range(wide):
            bits[at + j] = (value >> (wide - 1 - j)) & 1
        at = at + wide
    for j in range(4):
        bits[(codes_at - 4 + j)[rice]] = (k[rice] >> (3 - j)) & 1
    use = np.repeat(rice, sizes) & (within >= np.repeat(order, sizes))
    kk, zz = np.repeat(k, sizes)[use], z[use].astype(np.int64)
    q = zz >> kk
    length = q + kk + 1
    ahead = np.cumsum(length) - length
    per = np.where(rice, sizes - order, 0)
    firsts = np.concatenate([[0], np.cumsum(per)[:-1]])
    lead = ahead[np.minimum(firsts, max(len(ahead) - 1, 0))] if len(ahead) else np.zeros(n, np.int64)
    at = ahead + np.repeat(codes_at - lead, per)
    out = np.packbits(bits) | placed_codes(at + q, (zz & ((1 << kk) - 1)) | (1 << kk), kk + 1, int(ends[-1]))
    for i in range(n):
        b, h = int(begins[i]), int(head_sizes[i])
        out[b : b + h] = np.frombuffer(heads[i], np.uint8)
        s, size = int(starts[i]), int(sizes[i])
        if constant[i]:
            out[b + h], out[b + h + 1] = 0x00, signed[s]
        elif plain[i]:
            out[b + h] = 0x02
            out[b + h + 1 : b + h + 1 + size] = signed[s : s + size]
        else:
            o = int(order[i])
            out[b + h] = (0x20 | (o - 1)) << 1 if linear[i] else (0x08 | o) << 1
            out[b + h + 1 : b + h + 1 + o] = signed[s : s + o]
    crc = crc16_of(out, begins, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    raw = out.tobytes()
    return [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist())]


def stream_info(data: bytes, frames: list[bytes], rate: int = 8000) -> bytes:
    """The marker, STREAMINFO and a seek table with a point for each frame."""
    sizes = [len(f) for f in frames]
    block = max(16, min(BLOCK, len(data)))
    signed = (np.frombuffer(data, np.uint8) ^ 0x80).tobytes()
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((rate << 44) | (7 << 36) | len(data)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, offset = [], 0
    for i, size in enumerate(sizes):
        points.append((i * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(data) - i * BLOCK).to_bytes(2, "big"))
        offset += size
    seek = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek if len(seek) < 1 << 24 else b"fLaC\x80" + len(info).to_bytes(3, "big") + info


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of at least one byte."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    held, owners, held_bytes = [], [], 0

    def flush():
        if held:
            sizes = np.array([len(h) for h, _ in held], np.int64)
            done = encode_frames(np.frombuffer(b"".join(h for h, _ in held), np.uint8), sizes, np.array([i for _, i in held]))
            for owner, frame in zip(owners, done):
                frames[owner].append(frame)
            held.clear()
            owners.clear()

    for owner, payload in enumerate(payloads):
        for i in range(0, len(payload), BLOCK):
            held.append((payload[i : i + BLOCK], i // BLOCK))
            owners.append(owner)
            held_bytes += len(held[-1][0])
            if held_bytes >= GROUP_BYTES:
                flush()
                held_bytes = 0
    flush()
    return [stream_info(p, f) + b"".join(f) for p, f in zip(payloads, frames)]


class Corrupt(ValueError):
    """A stream that breaks the format or misses a checksum."""


def split_stream(raw: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """STREAMINFO's fields and the byte range of each frame, by the seek table or else by frame headers whose checksums hold."""
    if raw[:4] != b"fLaC":
        raise Corrupt("no FLAC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        block = raw[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[2:4], "big")}
        elif kind == 3:
            points = [int.from_bytes(block[i + 8 : i + 16], "big") for i in range(0, size, 18) if block[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    if info is None:
        raise Corrupt("no STREAMINFO")
    if len(points) * info["block"] >= info["samples"] > (len(points) - 1) * info["block"]:
        edges = [at + p for p in points] + [len(raw)]
        if any(b - a < 8 for a, b in zip(edges, edges[1:])):
            raise Corrupt("bad seek table")
        return info, list(zip(edges, edges[1:]))
    data = np.frombuffer(raw, np.uint8)
    found, begin = [], at
    marks = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] & 0xFE == 0xF8)) + at
    good = [int(m) for m in marks if _parse_header(raw, int(m), info) is not None]
    for nxt in [*good[1:], len(raw)]:
        if nxt - begin > 4 and int(crc16_of(data, np.array([begin]), np.array([nxt - 2]))[0]) == int.from_bytes(raw[nxt - 2 : nxt], "big"):
            found.append((begin, nxt))
            begin = nxt
    if begin != len(raw):
        raise Corrupt("frame checksum mismatch")
    return info, found


def _parse_header(raw: bytes, at: int, info: dict) -> dict | None:
    if len(raw) - at < 6 or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        return None
    block, rate, channels, depth = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 3] >> 4, raw[at + 3] >> 1 & 7
    lead = raw[at + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if not lead << (k + 1) & 0x80), 6)
    number = lead if not more else lead & (0x3F >> more)
    for b in raw[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    p = at + 5 + more
    if block == 0:
        return None
    if block in (6, 7):
        wide = block - 5
        size, p = int.from_bytes(raw[p : p + wide], "big") + 1, p + wide
    else:
        size = 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(raw) or crc8(raw[at:p]) != raw[p] or channels > 10:
        return None
    variable = raw[at + 1] & 1
    return {"size": size, "channels": channels, "bits": BITS_BY_CODE.get(depth, info["bits"]), "first": number if variable else number * info["block"], "body": p + 1}


_LEADING = np.zeros(1 << 16, np.uint8)
for _i in range(16):
    _LEADING[1 << _i : 2 << _i] = 15 - _i
_LEADING[0] = 16


def _rice_lanes(words: np.ndarray, pos: np.ndarray, counts: np.ndarray, first_counts: np.ndarray, part_counts: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode residuals of many frames at once: counts[i] codes from bit pos[i]; partitions have first_counts[i], then part_counts[i] codes. Gives a (codes, lanes) matrix and the bit after the last code."""
    lanes = np.argsort(-counts, kind="stable")
    pos, wide = pos[lanes].astype(np.int64), wide[lanes]
    left, each, counts_sorted = first_counts[lanes].copy(), part_counts[lanes], counts[lanes]
    k, raw_bits = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1)
    steps = int(counts_sorted.max(initial=0))
    out = np.zeros((steps, len(lanes)), np.int32)
    active = np.searchsorted(-counts_sorted, -np.arange(steps), side="left")
    u = np.uint64
    fetch = lambda p: words[p >> 3] << (p & 7).astype(u)
    fresh = np.ones(len(lanes), bool)
    until = 0
    for t in range(steps):
        m = int(active[t])
        if t >= until:
            while True:  # an empty partition still has its parameter
                due = np.flatnonzero(fresh[:m])
                if not len(due):
                    break
                width = np.where(wide[due], 5, 4)
                w = fetch(pos[due])
                k[due] = (w >> (64 - width).astype(u)).astype(np.int64)
                pos[due] += width
                escape = k[due] == (1 << width) - 1
                raw_bits[due] = -1
                if escape.any():
                    e = due[escape]
                    raw_bits[e] = (fetch(pos[e]) >> u(59)).astype(np.int64)
                    pos[e] += 5
                fresh[due] = left[due] == 0
                left[due] = np.where(left[due] == 0, each[due], left[due])
            until = t + int(left[:m].min())
            has_raw = bool((raw_bits[:m] >= 0).any())
            rest = (63 - k).astype(u)
        p, kk = pos[:m], k[:m]
        w = fetch(p)
        q = _LEADING[w >> u(48)].astype(np.int64)
        if q.max() == 16:
            long = np.flatnonzero(q == 16)
            if has_raw:
                long = long[raw_bits[long] < 0]
            more = long
            while len(more):
                part = _LEADING[(fetch(p[more] + q[more]) >> u(48)).astype(np.int64)]
                q[more] += part
                more = more[part == 16]
        after = p + q + 1
        r = ((fetch(after) >> u(1)) >> rest[:m]).astype(np.int64)
        z = (q << kk) | r
        value = (z >> 1) ^ -(z & 1)
        end = after + kk
        if has_raw:
            e = np.flatnonzero(raw_bits[:m] >= 0)
            nb = raw_bits[e]
            v = ((fetch(p[e]) >> u(1)) >> (63 - nb).astype(u)).astype(np.int64)
            value[e] = np.where(nb > 0, v - ((v >> np.maximum(nb - 1, 0)) << nb), 0)
            end[e] = p[e] + nb
        out[t, :m] = value
        pos[:m] = end
        if t + 1 >= until:
            left[:m] -= t + 1 - (until - int(left[:m].min()))
            done = left[:m] == 0
            fresh[:m] = done
            left[:m] = np.where(done, each[:m], left[:m])
    back = np.empty(len(lanes), np.int64)
    back[lanes] = np.arange(len(lanes))
    return out[:, back], pos[back]


def decode_frames(frames: list[bytes], infos: list[dict]) -> list[tuple[dict, np.ndarray]]:
    """(header, samples as (channels, size)) of each frame; both checksums of each are verified."""
    if not frames:
        return []
    sizes = np.array([len(f) for f in frames], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    raw = b"".join([*frames, b"\0" * 24])
    data = np.frombuffer(raw, np.uint8)
    crc = crc16_of(data, starts, starts + sizes - 2)
    stored = data[starts + sizes - 2].astype(np.int64) << 8 | data[starts + sizes - 1]
    if (crc != stored).any():
        raise Corrupt("frame checksum mismatch")
    heads = []
    for s, info in zip(starts, infos):
        h = _parse_header(raw, int(s), info)
        if h is None:
            raise Corrupt("frame header checksum mismatch")
        heads.append(h)
    wide = data.astype(np.uint64)
    words = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        words |= wide[j : j + len(words)] << np.uint64(56 - 8 * j)

    def take(at: int, n: int) -> int:
        end = (at + n + 7) >> 3
        return int.from_bytes(raw[at >> 3 : end], "big") >> ((end << 3) - at - n) & ((1 << n) - 1)

    def take_signed(at: int, n: int) -> int:
        v = take(at, n)
        return v - (v >> (n - 1) << n)

    pos = [h["body"] * 8 for h in heads]
    result = [np.zeros((h["channels"] + 1 if h["channels"] < 8 else 2, h["size"]), np.int64) for h in heads]
    for channel in range(max(len(r) for r in result)):
        todo = []
        for i, h in enumerate(heads):
            if channel >= len(result[i]):
                continue
            side = (h["channels"] in (8, 10) and channel == 1) or (h["channels"] == 9 and channel == 0)
            depth, size, at = h["bits"] + side, h["size"], pos[i]
            kind, wasted = take(at + 1, 6), 0
            at += 8
            if take(at - 1, 1):
                wasted = 1
                while not take(at, 1):
                    wasted, at = wasted + 1, at + 1
                at += 1
            depth -= wasted
            if kind == 0:
                result[i][channel] = take_signed(at, depth) << wasted
                pos[i] = at + depth
            elif kind == 1:
                if depth == 8 and at % 8 == 0:
                    result[i][channel] = data[at // 8 : at // 8 + size].view(np.int8)
                else:
                    result[i][channel] = [take_signed(at + depth * j, depth) for j in range(size)]
                result[i][channel] <<= wasted
                pos[i] = at + depth * size
            else:
                if 8 <= kind <= 12:
                    order, coefficients, shift = kind - 8, None, 0
                elif kind >= 32:
                    order = kind - 31
                else:
                    raise Corrupt("reserved subframe type")
                result[i][channel, :order] = [take_signed(at + depth * j, depth) for j in range(order)]
                at += depth * order
                if kind >= 32:
                    precision, shift = take(at, 4) + 1, take_signed(at + 4, 5)
                    coefficients = np.array([take_signed(at + 9 + precision * j, precision) for j in range(order)], np.int64)
                    at += 9 + precision * order
                method, parts = take(at, 2), take(at + 2, 4)
                if method > 1 or size % (1 << parts):
                    raise Corrupt("bad residual coding")
                todo.append((i, order, coefficients, shift, wasted, at + 6, method, size >> parts))
        if not todo:
            continue
        orders = np.array([x[1] for x in todo])
        each = np.array([x[7] for x in todo], np.int64)
        counts = np.array([heads[x[0]]["size"] for x in todo], np.int64) - orders
        residual, ends = _rice_lanes(words, np.array([x[5] for x in todo]), counts, each - orders, each, np.array([x[6] == 1 for x in todo]))
        linear: dict[int, list[int]] = {}
        for lane, (i, order, coefficients, shift, wasted, _, _, _) in enumerate(todo):
            row, e = result[i][channel], residual[: counts[lane], lane]
            pos[i] = int(ends[lane])
            if coefficients is None:
                for j in range(order - 1, -1, -1):  # integrate the residual order times, from the warm-up's own differences
                    e = np.cumsum(np.concatenate([[np.diff(row[: j + 1], j)[0]], e]))
                row[:] = e
                row <<= wasted
            else:
                linear.setdefault(order, []).append(lane)
        for order, lanes in linear.items():
            lanes.sort(key=lambda x: -len(result[todo[x][0]][channel]))  # those still going on at a step come first
            sizes = np.array([len(result[todo[x][0]][channel]) for x in lanes])
            kind = np.int32 if all(heads[todo[x][0]]["bits"] <= 8 for x in lanes) else np.int64  # 9 bits, 15 of a coefficient, 32 products
            steps = np.zeros((int(sizes[0]), len(lanes)), kind)  # a step's samples of all lanes lie together
            steps[order:] = residual[: len(steps) - order, lanes]
            steps[:order] = np.stack([result[todo[x][0]][channel, :order] for x in lanes], 1)
            weights = np.stack([todo[x][2][::-1] for x in lanes], 1).astype(kind)
            shifts = np.array([todo[x][3] for x in lanes], kind)
            going = np.searchsorted(-sizes, -np.arange(int(sizes[0])) - 1, "right")
            for t, m in enumerate(going[order:].tolist(), order):
                steps[t, :m] += np.add.reduce(steps[t - order : t, :m] * weights[:, :m], 0, kind) >> shifts[:m]
            steps = np.ascontiguousarray(steps.T)
            for x, row, size in zip(lanes, steps, sizes):
                result[todo[x][0]][channel] = row[:size].astype(np.int64) << todo[x][4]
    for h, r in zip(heads, result):
        if h["channels"] == 8:
            r[1] = r[0] - r[1]
        elif h["channels"] == 9:
            r[0] = r[1] + r[0]
        elif h["channels"] == 10:
            mid = (r[0] << 1) | (r[1] & 1)
            r[0], r[1] = (mid + r[1]) >> 1, (mid - r[1]) >> 1
    return list(zip(heads, result))


def decode_all(media: list[bytes], group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(stream, first sample, samples) of every PCM block of the streams, in order; the MD5 of each stream's samples is verified."""
    held, held_bytes = [], 0
    sums, infos = {}, {}

    def flush():
        for (owner, last), (h, samples) in zip([(o, e) for o, _, _, e in held], decode_frames([f for _, f, _, _ in held], [i for _, _, i, _ in held])):
            info = infos[owner]
            if any(info["md5"]):
                width = (info["bits"] + 7) // 8
                body = samples.T.astype("<i4")[..., None].view(np.uint8).reshape(*samples.T.shape, 4)[..., :width].tobytes()
                sums.setdefault(owner, hashlib.md5()).update(body)
                if last and sums.pop(owner).digest() != info["md5"]:
                    raise Corrupt("sample checksum mismatch")
            yield owner, h["first"], samples

    for owner, raw in enumerate(media):
        info, ranges = split_stream(raw)
        infos[owner] = info
        for j, (s, e) in enumerate(ranges):
            held.append((owner, raw[s:e], info, j == len(ranges) - 1))
            held_bytes += e - s
            if held_bytes >= group_bytes:
                yield from flush()
                held, held_bytes = [], 0
    yield from flush()


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % PAD if text else PAD)


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as UTF-8, padded with zero bytes to a positive multiple of 64, as a FLAC stream.

    Equal texts give equal streams; repeated rows are coded each. doc_id may be of any type. An empty table gives an empty one.
    Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 1, 2 << 20):
            data, at = joined_bytes(b.column(1))
            raw = data.tobytes()
            texts = [raw[s:e] for s, e in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(encode_all([padded(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n_bytes bigint, media binary")


BLOCKS = "array<struct<first_sample: bigint, n_samples: int, pcm: binary>>"


def stored_blocks(media: DataFrame) -> DataFrame:
    """The media column decoded and written to the shared folder: every column of media but `media` itself, and flac_bytes,
    flac_sha256, md5 (of the samples, as the stream says) and blocks: first_sample, n_samples and pcm (little-endian, channels
    interleaved, 8 bits a sample where all of a block fit) of each frame.

    Both checksums of every frame and the MD5 of every stream are verified before a block is written. A null media has no blocks.
    """
    kept = [c for c in media.columns if c != "media"]
    at = len(kept)
    block = pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])

    def decode(batches):
        for b in slices(batches, at, 2 << 20):
            given = [x.as_py() for x in b.column(at)]
            which = [i for i, x in enumerate(given) if x is not None]
            blocks = [None if x is None else [] for x in given]
            for o, first, s in decode_all([given[i] for i in which]):
                kind = np.int8 if s.max(initial=0) <= 127 and s.min(initial=0) >= -128 else "<i4"
                blocks[which[o]].append({"first_sample": first, "n_samples": s.shape[1], "pcm": s.T.astype(kind).tobytes()})
            digests = [None if x is None else hashlib.sha256(x).hexdigest() for x in given]
            sums = [None if x is None else split_stream(x)[0]["md5"] for x in given]
            yield pa.RecordBatch.from_arrays([
                *b.columns[:at], pa.array([None if x is None else len(x) for x in given], pa.int64()), pa.array(digests, pa.string()), pa.array(sums, pa.binary()), pa.array(blocks, pa.list_(block)),
            ], names=[*kept, "flac_bytes", "flac_sha256", "md5", "blocks"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.select(*kept).schema)
    decoded = map_arrow(media.select(*kept, "media"), decode, f"{schema}flac_bytes bigint, flac_sha256 string, md5 binary, blocks {BLOCKS}")
    return cut(decoded, "pcm-blocks", compression="zstd")


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, pcm of every stored block."""
    return stored.select("doc_id", F.inline("blocks"))


def samples_at(stored: DataFrame, first: int, n: int, width: int = 1) -> DataFrame:
    """doc_id, first_sample, pcm: samples first to first + n of every document, from the blocks that hold them alone; width bytes a sample."""
    low, high = F.greatest(F.col("first_sample"), F.lit(first)), F.least(F.col("first_sample") + F.col("n_samples"), F.lit(first + n))
    blocks = pcm_blocks(stored).where((F.col("first_sample") < first + n) & (F.col("first_sample") + F.col("n_samples") > first))
    part = F.substring("pcm", ((low - F.col("first_sample")) * width + 1).cast("int"), ((high - low) * width).cast("int"))
    return blocks.select("doc_id", low.alias("first_sample"), part.alias("pcm"))


def block_digests(stored: DataFrame) -> DataFrame:
    """The digests of what the stored blocks of encode_documents' media hold, per row. feature: samples, peak, sum of squares and
    zero crossings. Raises Corrupt where blocks miss an offset or their samples the stream's MD5."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "flac_bytes", "flac_sha256"]

    def digest(batches):
        for b in batches:
            rows = []
            lists = b.column(5)
            first, pcm = (lists.values.field(k) for k in ("first_sample", "pcm"))
            first = first.to_numpy()
            data, edges = joined_bytes(pcm)
            for r, (s, e) in enumerate(zip(lists.offsets.to_pylist(), lists.offsets.to_pylist()[1:])):
                raw = data[edges[s] : edges[e]]
                if (first[s:e] != edges[s:e] - edges[s]).any() or hashlib.md5(raw).digest() != b.column(4)[r].as_py():
                    raise Corrupt("stored blocks miss the stream's checksum")
                x = raw.view(np.int8).astype(np.int64)
                payload = (raw ^ 0x80).tobytes()
                lead = s + int(np.searchsorted(first[s:e], len(raw) - PAD, "right")) - 1  # the block that the last samples begin in, by its offset
                tail = data[edges[lead] + len(raw) - PAD - first[lead] : edges[e]] ^ 0x80
                feature = f"n={len(x)};peak={int(np.abs(x).max())};square={int((x * x).sum())};cross={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail.tobytes()), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            out = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(out, kinds)], b.column(2), b.column(3)], names=names)

    columns = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, flac_bytes bigint, flac_sha256 string"
    return map_arrow(stored.select("doc_id", "n_bytes", "flac_bytes", "flac_sha256", "md5", "blocks"), digest, f"doc_id {kind}, {columns}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_digests(stored_blocks(encode_documents(table(spark, sf_dir, "documents"))))
