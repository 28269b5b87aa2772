"""Operator 7: FLAC columns.

``encode`` writes native FLAC streams and ``decode`` reads them: subframes that
are constant, verbatim, fixed or linear-predicted, Rice residuals with either
parameter width, escapes and any partition order, wasted bits and the four
stereo layouts, with every frame's CRC-8 and CRC-16 and the stream's MD5
checked.  Frames of all streams of a group are decoded side by side: one step
takes the next residual, or the next predicted sample, of thousands of frames.
``read_blocks`` gives seekable PCM blocks: number, first sample, PCM bytes; the
query's digests are those of these blocks, and ``starts_crc32`` is the checksum of
their offsets.  At most ``RUN`` frames are decoded at a time, also of a long stream.

The encoder takes mono 8-bit samples.  Of each frame it chooses the cheapest of
constant, verbatim, fixed predictors of order 0 to 2 and a quantized linear
predictor of order 4, and writes a seek point per frame, by which the decoder
finds the frames; streams without seek points are searched frame by frame.

Nulls: a null text is stored as an empty one (64 zero bytes).  Repeated rows and
equal texts give equal values.  Very long texts are encoded and read back by runs of
frames.  Ties between predictors go to the first one tried.  An empty table gives an
empty result.  Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import byte_rows, documents, text_groups

BLOCK = 1024
RATE = 8000
ORDER, PRECISION = 4, 8
UNIT = 64
GROUP = 1 << 21


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & mask
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans, one byte of each per step; longest first."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, ordered = starts[order], sizes[order]
    crc = np.zeros(len(starts), dtype=np.uint16)
    table = CRC16.astype(np.uint16)
    active = np.searchsorted(-ordered, -np.arange(int(sizes.max(initial=0))) - 1, side="right")
    for t, lanes in enumerate(active):
        c = crc[:lanes]
        crc[:lanes] = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)) ^ data[begin[:lanes] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    rest = []
    limit = 0x40
    while True:
        rest.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0x100 - 2 * limit) & 0xFF | n, *reversed(rest)])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    extra = 1
    while first & (0x40 >> extra):
        extra += 1
    n = first & (0x3F >> extra)
    for i in range(1, extra + 1):
        n = n << 6 | data[at + i] & 0x3F
    return n, at + extra + 1


# --- encoder ---------------------------------------------------------------


class _Bits:
    """Bits of many frames, written field by field at known places."""

    def __init__(self, total: int):
        self.bits = np.zeros(total, dtype=np.uint8)

    def put(self, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            self.bits[at + j] = values >> (width - 1 - j) & 1


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized linear predictors of order ORDER for each row: coefficients and shifts (by the covariance method)."""
    f = x.astype(np.float64)
    lags = np.stack([f[:, ORDER - j : f.shape[1] - j] for j in range(ORDER + 1)])
    moments = np.einsum("ikn,jkn->kij", lags, lags, optimize=True)
    matrix, target = moments[:, 1:, 1:], moments[:, 1:, 0]
    matrix = matrix + np.eye(ORDER) * (1e-3 * (1 + np.trace(matrix, axis1=1, axis2=2)))[:, None, None]
    solved = np.linalg.solve(matrix, target[:, :, None])[:, :, 0]
    largest = np.abs(solved).max(axis=1)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(largest, 1e-9))), 0, 14).astype(np.int64)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(solved * (1 << shift)[:, None]), -most, most - 1).astype(np.int64), shift


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter per row and its cost in bits."""
    costs = np.stack([(u >> k).sum(axis=1) + u.shape[1] * (1 + k) for k in range(10)])
    return costs.argmin(axis=0), costs.min(axis=0)


def _encode_rows(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equal size, one per row of 8-bit samples."""
    rows, n = x.shape
    x = x.astype(np.int32)
    kinds = np.ones(rows, dtype=np.int64)  # the subframe type codes
    best = np.full(rows, 8 * n, dtype=np.int64)
    params = np.zeros(rows, dtype=np.int64)
    codes = np.zeros((rows, n), dtype=np.int32)
    coefs, shifts = np.zeros((rows, ORDER), dtype=np.int64), np.zeros(rows, dtype=np.int64)

    def offer(kind: int, order: int, residual: np.ndarray, extra: int) -> None:
        u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)[:, order:]
        k, cost = _rice(u)
        cost = cost + extra + 8 * order + 10
        better = cost < best
        best[better], params[better], kinds[better] = cost[better], k[better], kind
        codes[better, order:] = u[better]

    residual = x
    for order in range(3):
        if n > order:
            offer(8 + order, order, np.pad(residual, ((0, 0), (order, 0))), 0)
        residual = np.diff(residual, axis=1)
    if n >= 4 * ORDER:
        coefs, shifts = _predictors(x)
        guess = sum(coefs[:, j, None] * x[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER)) >> shifts[:, None]
        offer(32 + ORDER - 1, ORDER, np.pad(x[:, ORDER:] - guess.astype(np.int32), ((0, 0), (ORDER, 0))), 9 + ORDER * PRECISION)
    constant = (x == x[:, :1]).all(axis=1)
    kinds[constant], best[constant] = 0, 8

    size_code = bytes([0x70 | 4]) if n != BLOCK else bytes([0xA0 | 4])
    heads = []
    for number in numbers:
        head = b"\xff\xf8" + size_code + bytes([0x02]) + _utf8_number(number)
        if n != BLOCK:
            head += (n - 1).to_bytes(2, "big")
        heads.append(head + bytes([crc8(head)]))
    head_bits = 8 * np.array([len(h) for h in heads], dtype=np.int64)
    body = (best + 8 + 7) // 8 * 8
    frame_bits = head_bits + body + 16
    begins = np.cumsum(frame_bits) - frame_bits
    out = _Bits(int(frame_bits.sum()))
    at = begins + head_bits
    out.put(at, kinds << 1, 8)
    at = at + 8
    raw = x & 0xFF
    out.put(at[kinds == 0], raw[kinds == 0, 0], 8)
    plain = kinds == 1
    if plain.any():
        out.put((at[plain, None] + 8 * np.arange(n)).ravel(), raw[plain].ravel(), 8)
    for kind, order in ((8, 0), (9, 1), (10, 2), (32 + ORDER - 1, ORDER)):
        own = kinds == kind
        if not own.any():
            continue
        place = at[own]
        for j in range(order):
            out.put(place, raw[own, j], 8)
            place = place + 8
        if kind >= 32:
            out.put(place, np.full(len(place), PRECISION - 1), 4)
            out.put(place + 4, shifts[own], 5)
            place = place + 9
            for j in range(ORDER):
                out.put(place, coefs[own, j], PRECISION)
                place = place + PRECISION
        place = place + 6  # Rice with 4-bit parameters, partition order 0
        k = params[own]
        out.put(place, k, 4)
        u = codes[own][:, order:]
        q = u >> k[:, None]
        widths = q + 1 + k[:, None]
        ends = np.cumsum(widths, axis=1)
        low = (place[:, None] + 4 + ends - k[:, None]).astype(np.int64)
        out.bits[(low - 1).ravel()] = 1
        for kk in np.unique(k):
            of = k == kk
            out.put(low[of].ravel(), u[of].ravel(), int(kk))
    packed = np.packbits(out.bits)
    starts, ends = begins // 8, (begins + frame_bits) // 8
    for h, s in zip(heads, starts.tolist(), strict=True):
        packed[s : s + len(h)] = np.frombuffer(h, dtype=np.uint8)
    check = crc16_spans(packed, starts, ends - 2)
    packed[ends - 2], packed[ends - 1] = check >> 8, check & 0xFF
    return [packed[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of mono 8-bit samples (each byte less 128), with a seek point per frame."""
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for k in range(len(frames[i])):
            by_size.setdefault(min(BLOCK, len(p) - k * BLOCK), []).append((i, k))
    for size, places in by_size.items():
        for a in range(0, len(places), 2048):
            part = places[a : a + 2048]
            x = np.frombuffer(b"".join(payloads[i][k * BLOCK : k * BLOCK + size] for i, k in part), dtype=np.uint8)
            rows = (x.astype(np.int16) - 128).reshape(len(part), size)
            for (i, k), frame in zip(part, _encode_rows(rows, [k for _, k in part]), strict=True):
                frames[i][k] = frame
    out = []
    for p, parts in zip(payloads, frames, strict=True):
        sizes = [len(x) for x in parts]
        signed = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offset, seek = 0, b""
        for k, size in enumerate(sizes):
            seek += (k * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(p) - k * BLOCK).to_bytes(2, "big")
            offset += size
        blocks = [(0, info)]
        most = ((1 << 24) - 1) // 18 * 18  # a metadata block's limit; frames beyond are found by reading on
        blocks.append((3, seek[:most]))
        head = b"fLaC"
        for i, (kind, body) in enumerate(blocks):
            head += bytes([kind | 0x80 * (i == len(blocks) - 1)]) + len(body).to_bytes(3, "big") + body
        out.append(head + b"".join(parts))
    return out


# --- decoder ---------------------------------------------------------------


class BadStream(ValueError):
    """A stream that is not FLAC, is cut short, or fails one of its checksums."""


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    audio: int  # where the frames begin
    seek: list[tuple[int, int, int]]  # sample, byte after ``audio``, samples in the frame


def read_info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise BadStream("no fLaC mark")
    at, info, seek = 4, None, []
    while True:
        if at + 4 > len(stream):
            raise BadStream("metadata cut short")
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
        elif kind & 0x7F == 3:
            for i in range(0, size, 18):
                sample = int.from_bytes(body[i : i + 8], "big")
                if sample != (1 << 64) - 1:  # not a placeholder
                    seek.append((sample, int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")))
        at += 4 + size
        if kind & 0x80:
            break
    if info is None:
        raise BadStream("no stream information")
    return Info(*info, at, seek)


SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def read_head(stream: bytes, at: int, info: Info) -> tuple[int, int, int, int, int]:
    """A frame header's samples, layout code, bits, frame or sample number, and end; its CRC-8 is checked."""
    if stream[at : at + 1] != b"\xff" or stream[at + 1] & 0xFE != 0xF8:
        raise BadStream("no frame mark")
    size_code, rate_code = stream[at + 2] >> 4, stream[at + 2] & 15
    layout, depth = stream[at + 3] >> 4, stream[at + 3] >> 1 & 7
    number, end = _read_number(stream, at + 4)
    if size_code in (6, 7):
        extra = size_code - 5
        size = int.from_bytes(stream[end : end + extra], "big") + 1
        end += extra
    else:
        size = SIZES.get(size_code, 0)
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if not size or crc8(stream[at:end]) != stream[end]:
        raise BadStream("frame header fails its checksum")
    return size, layout, DEPTHS.get(depth, info.bits), number, end + 1


class _Reader:
    """Reads bits of many lanes, each from its own place in one array of bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        self.size = 8 * len(data)
        words = padded[:-7].copy()
        for j in range(1, 8):
            words <<= np.uint64(8)
            words |= padded[j : len(padded) - 7 + j]
        self.words = words

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from each place on, at least 57 of them, left-aligned."""
        if len(at) and at.max() >= self.size:
            raise BadStream("frame cut short")
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def bits(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of up to 57 bits."""
        width = np.asarray(width)
        shifted = self.window(at) >> (np.uint64(63) - np.maximum(width, 1).astype(np.uint64) + np.uint64(1))
        return np.where(width > 0, shifted, np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.bits(at, width)
        half = np.int64(1) << np.maximum(np.asarray(width) - 1, 0)
        return np.where(value >= half, value - 2 * half, value) * (np.asarray(width) > 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        count = np.zeros(len(at), dtype=np.int64)
        left = np.arange(len(at))
        while left.size:
            high = (self.window(at[left] + count[left]) >> np.uint64(32)).astype(np.int64)
            zeros = np.where(high > 0, 32 - _bit_length(high), 32)
            count[left] += zeros
            left = left[high == 0]
        return count


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _subframes(reader: _Reader, at: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode one subframe per lane: samples (time, lanes) and where each ended."""
    lanes, longest = len(at), int(size.max())
    out = np.zeros((longest, lanes), dtype=np.int64)
    kind = reader.bits(at, 8)
    at = at + 8
    if (kind & 0x80).any():
        raise BadStream("bad subframe")
    wasted = np.zeros(lanes, dtype=np.int64)
    if (has := (kind & 1) == 1).any():
        wasted[has] = reader.unary(at[has]) + 1
        at[has] += wasted[has]
    kind, bits = kind >> 1, bits - wasted
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    coded = (kind >= 32) | (kind >= 8) & (kind <= 12)
    if not (coded | (kind <= 1)).all():
        raise BadStream("reserved subframe")
    if (flat := kind == 0).any():
        out[:, flat] = reader.signed(at[flat], bits[flat])
        at[flat] += bits[flat]
    if (plain := np.flatnonzero(kind == 1)).size:
        for t in range(longest):
            plain = plain[size[plain] > t]
            out[t, plain] = reader.signed(at[plain], bits[plain])
            at[plain] += bits[plain]
    for t in range(int(order.max())):
        own = np.flatnonzero(order > t)
        out[t, own] = reader.signed(at[own], bits[own])
        at[own] += bits[own]
    coefs, shift = np.zeros((max(4, int(order.max())), lanes), dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    for o, c in enumerate(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
        fixed = kind == 8 + o
        for j, v in enumerate(c):
            coefs[j, fixed] = v
    if (linear := np.flatnonzero(kind >= 32)).size:
        precision = reader.bits(at[linear], 4) + 1
        shift[linear] = reader.signed(at[linear] + 4, 5)
        at[linear] += 9
        for j in range(int(order[linear].max())):
            more = order[linear] > j
            own = linear[more]
            coefs[j, own] = reader.signed(at[own], precision[more])
            at[own] += precision[more]
    if (lane := np.flatnonzero(coded)).size:
        lane = lane[np.argsort(-size[lane], kind="stable")]
        at[lane] = _residuals(reader, at[lane], size[lane], order[lane], out, lane)
        _predict(out, lane, size[lane], order[lane], coefs[:, lane], shift[lane])
    return out << wasted, at


def _residuals(reader: _Reader, at: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Rice-coded residuals into ``out`` from each lane's order on; lanes are sorted by size, longest first."""
    method = reader.bits(at, 2)
    if (method > 1).any():
        raise BadStream("reserved residual coding")
    width, escape = np.where(method == 0, 4, 5), np.where(method == 0, 15, 31)
    each = size >> reader.bits(at + 2, 4)
    at = at + 6
    k = np.zeros(len(at), dtype=np.int64)
    raw = np.full(len(at), -1, dtype=np.int64)
    active = np.searchsorted(-size, -np.arange(int(size.max())) - 1, side="right")
    opens = np.zeros(len(at), dtype=np.int64)  # the sample where the next partition begins
    for t, n in enumerate(active):
        own = np.flatnonzero((order[:n] <= t) & ((opens[:n] <= t)))
        if own.size:
            k[own] = reader.bits(at[own], width[own])
            at[own] += width[own]
            raw[own] = -1
            opens[own] = (t // each[own] + 1) * each[own]
            if (lost := own[k[own] == escape[own]]).size:
                raw[lost] = reader.bits(at[lost], 5)
                at[lost] += 5
        live = slice(0, n) if t >= 32 or (order[:n] <= t).all() else np.flatnonzero(order[:n] <= t)
        place, kk = at[live], k[live]
        if not len(place):
            continue
        window = reader.window(place)
        high = (window >> np.uint64(32)).astype(np.int64)
        zeros = 32 - _bit_length(high)
        if (zeros >= 25).any():  # long runs of zeros, one lane at a time further
            far = np.flatnonzero(zeros >= 25)
            zeros[far] = reader.unary(place[far])
            window[far] = reader.window(place[far] + zeros[far])
            window[far] <<= np.uint64(1)
            rest = window
            near = np.flatnonzero(zeros < 25)
            rest[near] = window[near] << (zeros[near] + 1).astype(np.uint64)
        else:
            rest = window << (zeros + 1).astype(np.uint64)
        low = ((rest >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = zeros << kk | low
        value = u >> 1 ^ -(u & 1)
        step = zeros + 1 + kk
        if (raw[live] >= 0).any():
            of = raw[live] >= 0
            value = np.where(of, reader.signed(place, np.maximum(raw[live], 0)), value)
            step = np.where(of, raw[live], step)
        out[t, lane[live]] = value
        at[live] = place + step
    return at


def _predict(out: np.ndarray, lane: np.ndarray, size: np.ndarray, order: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> None:
    """Turn residuals into samples; lanes of one order go side by side."""
    for o in np.unique(order):
        if o == 0:
            continue
        own = np.flatnonzero(order == o)
        x = np.ascontiguousarray(out[:, lane[own]])
        c, s = coefs[:o, own], shift[own]
        for t in range(int(o), int(size[own].max())):
            guess = c[0] * x[t - 1]
            for j in range(1, int(o)):
                guess += c[j] * x[t - 1 - j]
            x[t] += guess >> s
        out[:, lane[own]] = x


def _frames_of(stream: bytes, info: Info) -> list[tuple[int, int]]:
    """Byte span of every frame, by the seek points or else by search for the next valid header."""
    points = sorted({(s, info.audio + b) for s, b, _ in info.seek})
    sizes = {s: n for s, _, n in info.seek}
    reached = points[-1][0] + sizes[points[-1][0]] if points else 0
    whole = bool(points) and reached == info.samples and all(a[0] + sizes[a[0]] == b[0] for a, b in zip(points, points[1:], strict=False)) and points[0][0] == 0
    starts = [b for _, b in points] if whole else []
    if not whole:
        at = info.audio
        while at < len(stream):
            read_head(stream, at, info)
            starts.append(at)
            following = at + 6
            while True:
                following = stream.find(b"\xff", following)
                if following < 0 or following + 6 > len(stream):
                    following = len(stream)
                    break
                if stream[following + 1] & 0xFE == 0xF8:
                    try:
                        read_head(stream, following, info)
                        span = np.frombuffer(stream[at:following], dtype=np.uint8)
                        if not crc16_spans(span, np.array([0]), np.array([len(span)]))[0]:
                            break
                    except (BadStream, IndexError):
                        pass
                following += 1
            at = following
    return list(zip(starts, [*starts[1:], len(stream)], strict=True))


#: frames that are decoded side by side: what a reader holds at a time does not grow with a stream
RUN = 4096


def _decode_frames(frames: list[tuple[bytes, int, int, int, int]]) -> list[np.ndarray]:
    """Samples (time, channels) of frames (bytes, samples, layout code, bits, bytes of the header); CRC-16 is checked."""
    data = np.frombuffer(b"".join(f[0] for f in frames), dtype=np.uint8)
    sizes = np.array([len(f[0]) for f in frames], dtype=np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    size, layout, bits, head = (np.array([f[k] for f in frames], dtype=np.int64) for k in range(1, 5))
    if crc16_spans(data, begin, end).any():  # over a frame with its checksum the remainder is 0
        raise BadStream("frame fails its checksum")
    reader = _Reader(data)
    channels = np.where(layout < 8, layout + 1, 2)
    at = 8 * (begin + head)
    samples = np.zeros((int(channels.max()), int(size.max()), len(size)), dtype=np.int64)
    for c in range(int(channels.max())):
        own = np.flatnonzero(channels > c)
        side = ((layout[own] == 8) & (c == 1)) | ((layout[own] == 9) & (c == 0)) | ((layout[own] == 10) & (c == 1))
        found, stop = _subframes(reader, at[own], size[own], bits[own] + side)
        samples[c, : len(found), own] = found.T
        at[own] = stop
    if (at + 7 >> 3 != end - 2).any():
        raise BadStream("frame has another length than its subframes")
    if len(samples) > 1:
        a, b = samples[0], samples[1]
        left_side, right_side, mid_side = (np.flatnonzero(layout == v) for v in (8, 9, 10))
        b[:, left_side] = a[:, left_side] - b[:, left_side]
        a[:, right_side] += b[:, right_side]
        twice = a[:, mid_side] << 1 | b[:, mid_side] & 1
        a[:, mid_side], b[:, mid_side] = twice + b[:, mid_side] >> 1, twice - b[:, mid_side] >> 1
    return [samples[: channels[k], : size[k], k].T for k in range(len(frames))]


def decoded(streams: list[bytes]) -> Iterator[tuple[int, Info, list[tuple[int, np.ndarray]], bool]]:
    """Stream by stream its blocks (first sample, samples), at most ``RUN`` frames at a time: stream number, stream information, blocks, whether they are its last.

    Checks every frame's CRC-8 and CRC-16, and with a stream's last blocks its length and MD5.
    """
    waiting: list[tuple[bytes, int, int, int, int]] = []
    owners: list[tuple[int, Info, bool]] = []
    done, digest = 0, hashlib.md5()

    def flush() -> Iterator[tuple[int, Info, list[tuple[int, np.ndarray]], bool]]:
        nonlocal done, digest
        found = _decode_frames(waiting) if waiting else []
        i = 0
        while i < len(owners):
            j = i
            stream, info, _ = owners[i]
            blocks = []
            while j < len(owners) and owners[j][0] == stream:
                blocks.append((done, found[j]))
                done += len(found[j])
                j += 1
            last = owners[j - 1][2]
            if info.md5 != bytes(16):
                for _, x in blocks:
                    digest.update(pcm_bytes(x, info.bits))
            if last:
                if info.samples and done != info.samples:
                    raise BadStream("stream has another length than it says")
                if info.md5 != bytes(16) and digest.digest() != info.md5:
                    raise BadStream("samples fail the stream's checksum")
                done, digest = 0, hashlib.md5()
            yield stream, info, blocks, last
            i = j
        waiting.clear()
        owners.clear()

    for i, stream in enumerate(streams):
        info = read_info(stream)
        spans = _frames_of(stream, info)
        if not spans:
            yield from flush()
            if info.samples:
                raise BadStream("stream has another length than it says")
            yield i, info, [], True
        for k, (a, b) in enumerate(spans):
            n, layout, depth, _, after = read_head(stream, a, info)
            waiting.append((stream[a:b], n, layout, depth, after - a))
            owners.append((i, info, k == len(spans) - 1))
            if len(waiting) == RUN:
                yield from flush()
    yield from flush()


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """Of every stream its blocks: first sample and samples (time, channels)."""
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    for i, _, blocks, _ in decoded(streams):
        out[i] += blocks
    return out


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved signed little-endian PCM in whole bytes per sample."""
    width = (bits + 7) // 8
    if width == 3:
        return np.ascontiguousarray(samples.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return samples.astype({1: "i1", 2: "<i2", 4: "<i4"}[width]).tobytes()


BLOCKS = "key long, block int, sample_start long, n_samples int, channels int, bits int, rate int, pcm binary"
_BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def read_blocks(streams: list[bytes]) -> Iterator[tuple[int, list[tuple], bool]]:
    """Stream by stream its PCM blocks (block, sample_start, n_samples, channels, bits, rate, pcm), a bounded number at a time, and whether they are its last."""
    number = 0
    for i, info, blocks, last in decoded(streams):
        yield i, [(number + b, at, len(x), x.shape[1], info.bits, info.rate, pcm_bytes(x, info.bits)) for b, (at, x) in enumerate(blocks)], last
        number = 0 if last else number + len(blocks)


def pcm_blocks(media: DataFrame, key: str, column: str) -> DataFrame:
    """PCM blocks of a column of FLAC streams, seekable by (key, sample_start); null streams have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in text_groups(streams, GROUP):
                some = [k for k in range(i, j) if streams[k] is not None]
                rows: list[tuple] = []
                for k, blocks, _ in read_blocks([streams[k] for k in some]):
                    rows += [(keys[some[k]], *x) for x in blocks]
                    if len(rows) >= RUN:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_BLOCK_TYPES)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_BLOCK_TYPES)], names=names)

    return media.select(F.col(key).cast("long").alias("key"), F.col(column)).mapInArrow(run, BLOCKS)


def to_flac(docs: DataFrame) -> DataFrame:
    """doc_id and the FLAC stream of every text's padded payload."""
    return _over_texts(docs, lambda raw, media: [[m] for m in media], "flac binary", [pa.binary()])


def _payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


class Reading:
    """What is computed from a stream's PCM blocks as they are read back, without holding them."""

    def __init__(self):
        self.sha, self.starts, self.tail = hashlib.sha256(), 0, b""
        self.samples = self.blocks = self.energy = self.turns = 0
        self.low, self.high = 255, -255
        self.last = self.falling = None

    def add(self, blocks: list[tuple]) -> None:
        """The next blocks; each must begin where the one before ended."""
        at = self.samples
        for number, start, n, *_ in blocks:
            if (number, start) != (self.blocks, at):
                raise BadStream("blocks are not seekable by their offsets")
            self.blocks, at = self.blocks + 1, at + n
        self.starts = zlib.crc32(np.array([b[1] for b in blocks], dtype="<u8").tobytes(), self.starts)
        pcm = np.frombuffer(b"".join(b[6] for b in blocks), dtype=np.int8)
        back = (pcm.view(np.uint8) ^ 0x80).tobytes()
        self.sha.update(back)
        self.tail = (self.tail + back[-UNIT:])[-UNIT:]
        x = pcm.astype(np.int64)
        self.samples += len(x)
        self.low, self.high = min(self.low, int(x.min())), max(self.high, int(x.max()))
        self.energy += int((x * x).sum())
        falling = (np.diff(x) if self.last is None else np.diff(x, prepend=self.last)) < 0
        if len(falling):
            self.turns += int((falling[1:] != falling[:-1]).sum()) + (self.falling is not None and bool(falling[0]) != self.falling)
            self.falling = bool(falling[-1])
        self.last = int(x[-1])

    def feature(self) -> str:
        """Samples, peaks, energy and sign changes of the slope."""
        return f"n={self.samples};min={self.low};max={self.high};energy={self.energy};turns={self.turns}"


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int, starts_crc32 long"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]


def _over_texts(docs: DataFrame, make, schema: str, types: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
        for batch in batches:
            texts = byte_rows(batch.column(1))
            for i, j in text_groups(texts, GROUP):
                media = encode([_payload(t) for t in texts[i:j]])
                columns = zip(*make(texts[i:j], media), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, f"doc_id long, {schema}")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as FLAC, write the stored bytes back as PCM blocks with their sample offsets, and return digests of both."""

    def make(raw: list, media: list[bytes]) -> list:
        rows, reading = [], Reading()
        for i, blocks, last in read_blocks(media):
            reading.add(blocks)
            if last:
                rows.append(
                    (len(raw[i] or b""), reading.samples, reading.sha.hexdigest(), zlib.crc32(reading.tail), len(media[i]), hashlib.sha256(media[i]).hexdigest(), reading.feature(), reading.blocks, reading.starts)
                )
                reading = Reading()
        return rows

    return _over_texts(docs, make, DIGEST, _DIGEST_TYPES)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
