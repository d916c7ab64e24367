"""FLAC streams of 8-bit mono samples, encoded and decoded in lockstep over many frames with numpy.

The encoder writes STREAMINFO (with the MD5 of the samples), a SEEKTABLE with a point for every SEEK_FRAMES frames, and frames of 576 samples:
constant, verbatim, fixed (order 1) or linear-predictive (order 8), with Rice residuals in four partitions. The decoder reads any mono
8-bit stream of the format: constant, verbatim, fixed and linear-predictive subframes of all orders, both Rice methods with escapes,
all partition orders, wasted bits and block sizes. It starts a lane at each seek point, decodes the lanes' frames side by side, and verifies each
frame's header CRC-8, its CRC-16, and the stream's MD5.

A payload byte b is the sample b - 128. An empty payload is a stream without frames. Damaged streams raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, staged, steps

BLOCK, ORDER, PRECISION, PARTITIONS, SEEK_FRAMES, STEP_FRAMES, LANE_BYTES = 576, 8, 6, 4, 16, 2048, 4 << 20
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]  # fixed values: the format's polynomial predictors


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        top = (out >> np.uint32(bits - 1)) & 1
        out = ((out << np.uint32(1)) & np.uint32((1 << bits) - 1)) ^ top * np.uint32(poly)
    return out


_CRC8 = _crc_table(0x07, 8)
_CRC16 = _crc_table(0x8005, 16)
_places = [_CRC16.astype(np.uint16)[None, :]]


def _crc16_places(n: int) -> np.ndarray:
    """Row d, column b: what byte b adds to the CRC-16 with d bytes behind it."""
    if len(_places[0]) < n:
        rows = [_places[0][-1].astype(np.uint32)]
        out = [_places[0]]
        for _ in range(len(_places[0]), max(n, 2 * len(_places[0]), 700)):
            rows = [((rows[0] << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[rows[0] >> np.uint32(8)]]
            out.append(rows[0].astype(np.uint16)[None, :])
        _places[0] = np.concatenate(out)
    return _places[0]


def _crc16(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    last = np.cumsum(size)
    table = _crc16_places(int(size.max(initial=1)))
    place = np.arange(last[-1]) - np.repeat(last - size, size)
    parts = table[np.repeat(size, size) - 1 - place, raw[np.repeat(start, size) + place]]
    return np.bitwise_xor.reduceat(parts, last - size)


def _autocorrelation_predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each row, by Levinson's recursion."""
    f = x.astype(np.float32) * np.hanning(BLOCK + 2)[1:-1].astype(np.float32) ** 0.25
    r = np.stack([np.einsum("ij,ij->i", f[:, : BLOCK - k], f[:, k:]) for k in range(ORDER + 1)], 1).astype(np.float64)
    a = np.zeros((len(x), ORDER))
    err = r[:, 0] * (1 + 1e-4) + 1
    for k in range(ORDER):
        reflect = (r[:, k + 1] - (a[:, :k] * r[:, k:0:-1]).sum(1)) / err
        a[:, :k] -= reflect[:, None] * a[:, :k][:, ::-1].copy()
        a[:, k] = reflect
        err = np.maximum(err * (1 - reflect**2), 1e-3)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32), shift


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag residuals, the best parameter of each partition, and the bits of all partitions."""
    u = ((residual << 1) ^ (residual >> 31)).astype(np.uint32)
    u[:, :order] = 0
    parts = u.reshape(len(u), PARTITIONS, -1)
    count = np.full(PARTITIONS, parts.shape[2])
    count[0] -= order
    cost = np.stack([(parts >> np.uint32(k)).sum(2, dtype=np.int64) + count * (k + 1) for k in range(9)])
    best = cost.argmin(0)
    return u, best, np.take_along_axis(cost, best[None], 0)[0].sum(1)


def _number(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: six byte columns and their bits."""
    value, bits = np.zeros((len(frame), 6), np.int64), np.zeros((len(frame), 6), np.int64)
    size = 1 + (frame > 0x7F).astype(np.int64) + (frame > 0x7FF) + (frame > 0xFFFF) + (frame > 0x1FFFFF) + (frame > 0x3FFFFFF)
    for j in range(6):
        rest = frame >> (6 * np.maximum(size - 1 - j, 0))
        lead = np.where(size == 1, frame, ((0xFF00 >> size) & 0xFF) | rest)
        value[:, j] = np.where(j == 0, lead, 0x80 | (rest & 0x3F))
        bits[:, j] = np.where(j < size, 8, 0)
    return value, bits


def _encode_frames(x: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames, one after the other, and the offsets of the frames in them."""
    n = len(x)
    x = x.astype(np.int32)
    coefs, shift = _autocorrelation_predictor(x)
    pred = np.zeros_like(x)
    for j in range(ORDER):
        pred[:, ORDER:] += coefs[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    lpc = x - (pred >> shift[:, None].astype(np.int32))
    fixed = x.copy()
    fixed[:, 1:] -= x[:, :-1]
    u, k, bits = _rice(lpc, ORDER)
    u1, k1, bits1 = _rice(fixed, 1)
    bits = bits + 8 * ORDER + 9 + PRECISION * ORDER
    constant = (x == x[:, :1]).all(1)
    plain = ~constant & (np.minimum(bits, bits1 + 8) >= 8 * BLOCK)
    one = ~constant & ~plain & (bits1 + 8 < bits)
    u[one], k[one] = u1[one], k1[one]
    coded = ~constant & ~plain
    order = np.where(one, 1, ORDER)
    kind = np.select([constant, plain, one], [0, 1, 8 + 1], 32 + ORDER - 1)
    # Fields in stream order; a field that a frame lacks has no bits.
    per = BLOCK // PARTITIONS
    head = np.zeros((n, 11), np.int64)
    hbits = np.zeros((n, 11), np.int64)
    head[:, 0], head[:, 1], head[:, 2] = 0xFFF8, 0x20, 0x02
    hbits[:, :3] = (16, 8, 8)
    head[:, 3:9], hbits[:, 3:9] = _number(frame)
    crc = np.zeros(n, np.uint32)
    for byte in (np.full(n, 0xFF), np.full(n, 0xF8), head[:, 1], head[:, 2]):
        crc = _CRC8[crc ^ byte.astype(np.uint32)]
    for j in range(3, 9):
        crc = np.where(hbits[:, j] > 0, _CRC8[crc ^ head[:, j].astype(np.uint32)], crc)
    head[:, 9], hbits[:, 9] = crc, 8
    head[:, 10], hbits[:, 10] = kind << 1, 8
    unsigned = x & 0xFF
    warm = unsigned[:, :ORDER].astype(np.int64)
    wbits = np.where(coded[:, None] & (np.arange(ORDER) < order[:, None]), 8, 0)
    wbits[constant, 0] = 8
    predictor = np.concatenate([np.full((n, 1), PRECISION - 1), shift[:, None], coefs & ((1 << PRECISION) - 1), np.full((n, 1), PARTITIONS.bit_length() - 1)], 1).astype(np.int64)
    pbits = np.zeros((n, ORDER + 3), np.int64)
    is_lpc = coded & ~one
    pbits[is_lpc, 0], pbits[is_lpc, 1], pbits[is_lpc, 2:-1] = 4, 5, PRECISION
    pbits[coded, -1] = 6
    body = np.zeros((n, PARTITIONS, per + 1), np.int64)
    bbits = np.zeros((n, PARTITIONS, per + 1), np.int64)
    body[:, :, 0], bbits[:, :, 0] = k, 4
    parts = u.reshape(n, PARTITIONS, per).astype(np.int64)
    kk = k[:, :, None]
    body[:, :, 1:] = (1 << kk) | (parts & ((1 << kk) - 1))
    bbits[:, :, 1:] = (parts >> kk) + 1 + kk
    first = bbits[:, 0, 1 : ORDER + 1]
    first[np.arange(ORDER) < order[:, None]] = 0
    bbits[~coded] = 0
    if plain.any():
        body[plain, :, 1:] = unsigned[plain].reshape(-1, PARTITIONS, per)
        bbits[plain, :, 1:] = 8
    value = np.concatenate([head, warm, predictor, body.reshape(n, -1)], 1)
    nbits = np.concatenate([hbits, wbits, pbits, bbits.reshape(n, -1)], 1)
    ends = np.cumsum(nbits, 1)
    size = (ends[:, -1] + 7) // 8 + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    end = (ends + 8 * offs[:-1, None]).ravel()
    value, nbits = value.ravel(), nbits.ravel()
    some = nbits > 0
    end, value = end[some], value[some]
    # A field's value has 16 bits at most and so touches two 16-bit words at most.
    word, low = (end - 1) >> 4, 15 - ((end - 1) & 15)
    wide = value << low
    total = int(offs[-1] + 3) // 2 + 1
    words = np.bincount(word, wide & 0xFFFF, total) + np.bincount(np.maximum(word - 1, 0), wide >> 16, total)
    raw = words.astype(np.uint16).astype(">u2").view(np.uint8)[: offs[-1]].copy()
    crc = _crc16(raw, offs[:-1], offs[1:] - 2)
    raw[offs[1:] - 2], raw[offs[1:] - 1] = crc >> 8, crc & 0xFF
    return raw, offs


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; their sizes must be multiples of the block size."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads come in multiples of {BLOCK} bytes")
    every = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pieces, sizes = [], []
    for a in range(0, len(every), STEP_FRAMES):
        raw, offs = _encode_frames(every[a : a + STEP_FRAMES], number[a : a + STEP_FRAMES])
        pieces.append(raw)
        sizes.append(np.diff(offs))
    raw = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out, f = [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        own = sizes[f : f + n]
        samples = n * BLOCK
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min(initial=1 << 24) if n else 0).to_bytes(3, "big") + int(own.max(initial=0)).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        points = np.zeros(-(-n // SEEK_FRAMES), [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"] = np.arange(len(points)) * SEEK_FRAMES * BLOCK
        points["offset"] = (at[f : f + n : SEEK_FRAMES] - at[f]) if n else 0
        points["count"] = BLOCK
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + points.tobytes() + raw[at[f] : at[f + n]].tobytes())
        f += n
    return out


class _Bits:
    """Reads bits at many places of one byte array at once."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        wide = self.raw.astype(np.uint64)
        self.win = np.zeros(len(raw) + 8, np.uint64)
        for k in range(8):
            self.win |= wide[k : k + len(self.win)] << np.uint64(56 - 8 * k)
        self.most = len(raw) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        if len(pos) and int(pos.max()) > self.most:
            raise ValueError("the stream ends inside a frame")
        return self.win[pos >> 3] << (pos & 7).astype(np.uint64)

    def get(self, pos: np.ndarray, n) -> np.ndarray:
        return ((self.window(pos) >> np.uint64(1)) >> np.asarray(63 - np.asarray(n), np.uint64)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        value, n = self.get(pos, n), np.asarray(n, np.int64)
        return np.where((value >> np.maximum(n - 1, 0)) & (n > 0), value - (1 << n), value)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits from each place to the next one bit."""
        top = self.window(pos) >> np.uint64(11)
        out = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        far = top == 0
        if far.any():
            out[far] = 46 + self.zeros(pos[far] + 46)
        return out


def _header(stream: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """(place of the first frame, samples, MD5, seek points as (sample, byte offset)) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, samples, digest, points = 4, 0, b"", np.zeros((0, 2), np.int64)
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            samples, digest = packed & ((1 << 36) - 1), body[18:34]
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only mono streams of 8 bits")
        elif kind & 127 == 3:
            table = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
            table = table[table["sample"] != (1 << 64) - 1]
            points = np.stack([table["sample"].astype(np.int64), table["offset"].astype(np.int64)], 1)
        at += 4 + size
        if kind & 128:
            return at, samples, digest, points


def decode(streams: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The payload of each stream, and the sample offsets at which its PCM blocks begin."""
    heads = [_header(s) for s in streams]
    bits = _Bits(np.frombuffer(b"".join(streams), np.uint8))
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    out_base = np.concatenate([[0], np.cumsum([h[1] for h in heads])]).astype(np.int64)
    pcm = np.zeros(int(out_base[-1]), np.int16)
    lane_pos, lane_out, lane_end = [], [], []
    for k, (first, samples, _, points) in enumerate(heads):
        if not samples:
            continue
        if len(points) == 0 or points[0, 0] != 0:
            points = np.array([[0, 0]])
        lane_pos.append(8 * (base[k] + first + points[:, 1]))
        lane_out.append(out_base[k] + points[:, 0])
        lane_end.append(out_base[k] + np.append(points[1:, 0], samples))
    starts = [[] for _ in streams]
    if lane_pos:
        pos, out, end = np.concatenate(lane_pos), np.concatenate(lane_out), np.concatenate(lane_end)
        while len(pos):
            pos, size = _decode_round(bits, pos, out, pcm)
            owner = np.searchsorted(out_base, out, "right") - 1
            for k, o in zip(owner.tolist(), out.tolist(), strict=True):
                starts[k].append(o - int(out_base[k]))
            out = out + size
            if (out > end).any():
                raise ValueError("a frame runs over the next seek point")
            left = out < end
            pos, out, end = pos[left], out[left], end[left]
    payloads = []
    for k, (_, _, digest, _) in enumerate(heads):
        signed = pcm[out_base[k] : out_base[k + 1]].astype(np.int8)
        if any(digest) and hashlib.md5(signed.tobytes()).digest() != digest:
            raise ValueError("the samples' MD5 doesn't match")
        payloads.append(signed.view(np.uint8) ^ 0x80)
    return payloads, [np.array(sorted(s), np.int64) for s in starts]


# The format's block size codes; those of 6 and 7 are read from the header.
_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])


def _decode_round(bits: _Bits, pos: np.ndarray, out: np.ndarray, pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode one frame of each lane into pcm; the lanes' next places and the frames' sizes."""
    begin = pos >> 3
    if (bits.get(pos, 15) != 0x7FFC).any():
        raise ValueError("a frame doesn't begin with the sync code")
    code, rate, channel, depth = bits.get(pos + 16, 4), bits.get(pos + 20, 4), bits.get(pos + 24, 4), bits.get(pos + 28, 3)
    if channel.any() or ((depth != 0) & (depth != 1)).any():
        raise ValueError("only mono frames of 8 bits")
    lead = bits.get(pos + 32, 8)
    ones = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = pos + 32 + 8 * ones
    extra = np.where(code == 6, 8, np.where(code == 7, 16, 0))
    size = np.where(extra > 0, bits.get(at, extra) + 1, _SIZES[code])
    at = at + extra + np.where(rate == 12, 8, np.where((rate == 13) | (rate == 14), 16, 0))
    if (size == 0).any() or (out + size > len(pcm)).any():
        raise ValueError("a frame's size is wrong")
    length = (at - pos) >> 3
    crc = np.zeros(len(pos), np.uint32)
    for j in range(int(length.max())):
        crc = np.where(j < length, _CRC8[crc ^ bits.raw[begin + np.minimum(j, length)]], crc)
    if (crc != bits.get(at, 8)).any():
        raise ValueError("a frame header's CRC-8 doesn't match")
    at = at + 8
    kind = bits.get(at, 7) & 63
    wasted = bits.get(at + 7, 1)
    at = at + 8
    if wasted.any():
        more = wasted > 0
        run = bits.zeros(at[more]) + 1
        wasted[more] = run
        at[more] += run
    width = 8 - wasted
    most = int(size.max())
    x = np.zeros((len(pos), 32 + most), np.int64)  # 32 zero columns before the samples
    lanes = np.flatnonzero(kind == 0)
    if len(lanes):
        x[lanes, 32:] = bits.signed(at[lanes], width[lanes])[:, None]
        at[lanes] += width[lanes]
    lanes = np.flatnonzero(kind == 1)
    if len(lanes):
        for i in range(int(size[lanes].max())):
            live = lanes[i < size[lanes]]
            x[live, 32 + i] = bits.signed(at[live], width[live])
            at[live] += width[live]
    lanes = np.flatnonzero(((kind >= 8) & (kind <= 12)) | (kind >= 32))
    if len(lanes) + (kind <= 1).sum() != len(pos):
        raise ValueError("a reserved subframe type")
    if len(lanes):
        at[lanes] = _decode_predicted(bits, at[lanes], kind[lanes], width[lanes], size[lanes], x, lanes)
    final = (at + 7) >> 3
    if (_crc16(bits.raw, begin, final) != bits.get(final * 8, 16)).any():
        raise ValueError("a frame's CRC-16 doesn't match")
    x = x[:, 32:] << wasted[:, None]
    inside = np.arange(most) < size[:, None]
    pcm[(out[:, None] + np.arange(most))[inside]] = x[inside]
    return final * 8 + 16, size


def _decode_predicted(bits: _Bits, at: np.ndarray, kind: np.ndarray, width: np.ndarray, size: np.ndarray, x: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    n = len(lanes)
    order = np.where(kind >= 32, kind - 31, kind - 8)
    top = int(order.max())
    own = np.zeros((n, 32 + int(size.max())), np.int64)
    for i in range(top):
        live = i < order
        own[live, 32 + i] = bits.signed(at[live], width[live])
        at = at + np.where(live, width, 0)
    coefs = np.zeros((n, max(top, 1)), np.int64)  # column j: of the sample j + 1 back
    shift = np.zeros(n, np.int64)
    lpc = kind >= 32
    precision = np.where(lpc, bits.get(at, 4) + 1, 0)
    shift = np.where(lpc, bits.signed(at + 4, 5), 0)
    if (shift < 0).any() or (precision == 16).any():
        raise ValueError("a reserved predictor")
    at = at + np.where(lpc, 9, 0)
    for j in range(top):
        live = lpc & (j < order)
        coefs[live, j] = bits.signed(at[live], precision[live])
        at = at + np.where(live, precision, 0)
    for o in range(1, 5):
        coefs[np.ix_((kind - 8 == o) & ~lpc, np.arange(o))] = _FIXED[o]
    method, porder = bits.get(at, 2), bits.get(at + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved residual method")
    at = at + 6
    per = size >> porder
    pbits = np.where(method == 1, 5, 4)
    k, raw = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    back = coefs[:, ::-1].copy()
    depth = back.shape[1]
    for i in range(int(size.max())):
        turn = (i < size) & ((i == order) | ((i % per == 0) & (i > order)))
        if turn.any():
            k[turn] = bits.get(at[turn], pbits[turn])
            at = at + np.where(turn, pbits, 0)
            escape = turn & (k == (1 << pbits) - 1)
            raw = np.where(turn, -1, raw)
            if escape.any():
                raw[escape] = bits.get(at[escape], 5)
                at = at + np.where(escape, 5, 0)
        live = (i >= order) & (i < size)
        q = bits.zeros(at)
        u = (q << k) | bits.get(at + q + 1, k)
        value = (u >> 1) ^ -(u & 1)
        step = q + 1 + k
        plain = raw >= 0
        if plain.any():
            value = np.where(plain, bits.signed(at, np.maximum(raw, 0)), value)
            step = np.where(plain, raw, step)
        guess = (back * own[:, 32 + i - depth : 32 + i]).sum(1) >> shift
        if live.all():
            own[:, 32 + i] = value + guess
            at = at + step
        else:
            own[live, 32 + i] = (value + guess)[live]
            at = at + np.where(live, step, 0)
    x[lanes, : own.shape[1]] = own
    return at


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of the block size."""
    return text + b"\xff" * ((-len(text)) % BLOCK if text else BLOCK)


MEDIA = "doc_id long, n_bytes long, media binary"


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of each whole text's padded bytes. A null or empty text is one block of 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            media = encode([payload_of(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    # Larger batches than elsewhere: the decoder's lanes work side by side.
    return documents(docs, rows=2000).mapInArrow(run, MEDIA)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): the decoded blocks of each stream, each at its sample offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media", LANE_BYTES):
            payloads, starts = decode(batch.column("media").to_pylist())
            for doc_id, payload, begin in zip(batch.column("doc_id").to_pylist(), payloads, starts, strict=True):
                ends = np.append(begin[1:], len(payload))
                rows = [[doc_id] * len(begin), list(range(len(begin))), begin.tolist(), (ends - begin).tolist(), [payload[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def feature_of(payload: np.ndarray) -> str:
    """Samples, energy, peak and zero crossings of decoded samples."""
    s = payload.astype(np.int64) - 128
    return f"samples={len(s)};energy={int((s * s).sum())};peak={int(np.abs(s).max(initial=0))};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of each stream and of the samples that it decodes to."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media", LANE_BYTES):
            streams = batch.column("media").to_pylist()
            payloads, _ = decode(streams)
            raw = [p.tobytes() for p in payloads]
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array([zlib.crc32(r[-32:]) for r in raw], pa.int64()), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                pa.array([feature_of(p) for p in payloads], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in DIGESTS.split(", ")])

    return media.mapInArrow(run, DIGESTS)


def stored_media_digests(docs: DataFrame) -> DataFrame:
    """Store every text's FLAC stream in the shared folder, read the stored bytes back and digest them."""
    # Large pages, so that copies of a text a few thousand rows apart are found by the compression.
    return media_digests(staged(encode_media(docs), "media", compression="zstd", **{"parquet.page.size": str(16 << 20), "parquet.compression.codec.zstd.level": "9"}))
