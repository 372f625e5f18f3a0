"""Media columns: FLAC streams of one channel of 8-bit samples.

The encoder writes frames of BLOCK samples, each as a verbatim, constant, fixed or linear-predictor subframe (its
coefficients fitted to the frame by the Levinson-Durbin recursion) with Rice-coded residuals, whichever is smallest,
and seek points. The decoder finds the frames by the seek table, or by their sync codes, numbers and checksums where
points are missing, verifies each header's CRC-8 and each frame's CRC-16, undoes the Rice code and the predictors for
many frames side by side, and checks the whole stream's MD5. Both work on slices of frames, so memory is bounded
whatever a text's length. Numbers follow the format's public description (RFC 9639).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, plain_columns, text_bytes, tidy

BLOCK, RATE, UNIT = 576, 8000, 192
#: Order of the fitted predictors and bits of a coefficient.
LPC_ORDER, PRECISION = 4, 8
_MAX_RICE = 7
#: Bytes of texts handled at once, and frames coded side by side: these make the numpy steps long, and bound their memory.
CHUNK, SLICE = 3 << 20, 4096
#: Seek points of a stream at most: the table's length has 24 bits.
POINTS = 900_000


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, a byte of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    pos, size = starts[order].copy(), sizes[order]
    crc = np.zeros(len(order), np.uint16)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k in alive.tolist():
        c = crc[:k]
        crc[:k] = (c << np.uint16(8)) ^ _CRC16.take((c >> np.uint16(8)) ^ data[pos[:k]])
        pos[:k] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _number(n: int) -> bytes:
    """A frame's number in the format's UTF-8 like code."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _head(n: int, size: int) -> bytes:
    code, tail = (4 - 2, b"") if size == BLOCK else (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))
    head = b"\xff\xf8" + bytes([code << 4, 1 << 1]) + _number(n) + tail  # rate from the stream's head, one channel, 8 bits
    return head + bytes([crc8(head)])


class _Bits:
    """Gathers (position, value, width) of bit fields and packs them at once."""

    def __init__(self, total: int) -> None:
        self.bits = np.zeros(total, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for i in range(width):
            self.bits[at + i] = value >> (width - 1 - i) & 1


def fitted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole coefficients (frames x LPC_ORDER) of linear predictors, and their shifts: the Levinson-Durbin recursion on each frame's autocorrelation."""
    count, n = x.shape
    p = LPC_ORDER
    y = x.astype(np.float32) * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : n - k], y[:, k:]) for k in range(p + 1)]).astype(np.float64)
    r[0] = r[0] * (1 + 1e-6) + 1e-3
    a, err = np.zeros((p, count)), r[0].copy()
    for i in range(p):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i] -= k * a[:i][::-1]
        a[i] = k
        err *= 1 - k * k
    most = np.abs(a).max(axis=0)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-9) * (1 + 2.0 ** (1 - PRECISION)))), 0, 15).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit, limit).astype(np.int32).T, shift


def _residuals(x: np.ndarray, coefficients: np.ndarray | None, shift: np.ndarray | None) -> list[np.ndarray]:
    """Residuals of fixed orders 0 to 2 and, with coefficients, of the fitted predictors, in rows of a block; the first samples, as many as the order, are kept as they are."""
    out = [x]
    for order in (1, 2):
        r = x.copy()
        r[:, order:] = x[:, 1:] - x[:, :-1] if order == 1 else x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
        out.append(r)
    if coefficients is None:
        return out
    p, n = LPC_ORDER, x.shape[1]
    guess = sum(coefficients[:, j : j + 1] * x[:, p - 1 - j : n - 1 - j] for j in range(p))
    r = x.copy()
    r[:, p:] -= guess >> shift[:, None]
    return [*out, r]


_ORDER = (0, 1, 2, LPC_ORDER)


def encoded(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (at least one byte; sample = byte - 128)."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
    data = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
    whole: list[bytes] = []
    for at in range(0, len(owner), SLICE):
        whole += _frames(data, begin[at : at + SLICE], length[at : at + SLICE], nth[at : at + SLICE])
    out, at = [], 0
    for p, k in zip(payloads, frames.tolist(), strict=True):
        out.append(_stream(p, whole[at : at + k]))
        at += k
    return out


def _frames(data: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: np.ndarray) -> list[bytes]:
    bodies: list[bytes] = [b""] * len(begin)
    for n in np.unique(length):  # frames of one length are coded together
        rows = np.flatnonzero(length == n)
        coded = _coded(data[begin[rows][:, None] + np.arange(n)].astype(np.int32) - 128)
        heads: dict[int, bytes] = {}
        for i, body in zip(rows.tolist(), coded, strict=True):
            k = int(nth[i])
            if k not in heads:
                heads[k] = _head(k, int(n))
            bodies[i] = heads[k] + body
    sizes = np.array([len(b) for b in bodies], np.int64)
    sums = crc16(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, sizes).astype(">u2").tobytes()
    return [b + sums[2 * i : 2 * i + 2] for i, b in enumerate(bodies)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    small = min(len(payload), BLOCK)
    least = small if len(frames) == 1 else BLOCK
    digest = hashlib.md5()
    for a in range(0, len(payload), CHUNK):
        digest.update((np.frombuffer(payload, np.uint8, min(CHUNK, len(payload) - a), a) ^ np.uint8(0x80)).tobytes())
    info = struct.pack(">HH", max(16, least), max(16, BLOCK if len(frames) > 1 else small)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest.digest()
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"] = np.arange(len(frames)) * BLOCK
    points["offset"][1:] = np.cumsum(sizes)[:-1]
    points["n"] = BLOCK
    points["n"][-1] = len(payload) - BLOCK * (len(frames) - 1)
    table = points[:: -(-len(frames) // POINTS)].tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def _coded(x: np.ndarray) -> list[bytes]:
    """Subframes of a block of equally long frames (rows), padded to whole bytes."""
    count, n = x.shape
    fit = fitted(x) if n > 4 * LPC_ORDER else (None, None)
    variants = _residuals(x, *fit)
    # The cost of each parameter follows from the folded residuals' mean; ks has the parameters.
    ks = np.arange(2, _MAX_RICE + 1)[:, None]
    cost, rice, folds = np.full((len(variants), count), 1e9), np.zeros((len(variants), count), np.int64), []
    for v, r in enumerate(variants):
        o = _ORDER[v]
        folds.append((r << 1) ^ (r >> 31))
        if n > o:
            mean = folds[v][:, o:].mean(axis=1)
            bits = 8 * o + (n - o) * (ks + 1 + np.maximum(mean / 2.0**ks - 0.5, 0.0)) + (0 if v < 3 else 9 + LPC_ORDER * PRECISION)
            cost[v], rice[v] = bits.min(axis=0), bits.argmin(axis=0) + 2
    best = cost.argmin(axis=0)
    verbatim = cost.min(axis=0) >= 8 * n - 10
    constant = (x == x[:, :1]).all(axis=1)
    out: list[bytes] = [b""] * count
    for i in np.flatnonzero(constant).tolist():
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    plain = np.flatnonzero(verbatim & ~constant)
    raw = (x & 0xFF).astype(np.uint8)
    for i in plain.tolist():
        out[i] = b"\x02" + raw[i].tobytes()
    todo = ~verbatim & ~constant
    for v in range(len(variants)):
        for k in range(2, _MAX_RICE + 1):
            rows = np.flatnonzero(todo & (best == v) & (rice[v][np.arange(count)] == k))
            if len(rows):
                for i, b in zip(rows.tolist(), _packed(x[rows], folds[v][rows], v, k, *((fit[0][rows], fit[1][rows]) if v == 3 else (None, None))), strict=True):
                    out[i] = b
    return out


def _packed(x: np.ndarray, fold: np.ndarray, v: int, k: int, coefficients: np.ndarray | None, shift: np.ndarray | None) -> list[bytes]:
    count, n = x.shape
    o = _ORDER[v]
    q = fold[:, o:] >> k
    head = 8 + 8 * o + (0 if v < 3 else 9 + LPC_ORDER * PRECISION) + 10
    ends = np.cumsum(q + 1 + k, axis=1, dtype=np.int64)
    nbits = head + ends[:, -1]
    nbytes = -(-nbits // 8)
    base = 8 * (np.cumsum(nbytes) - nbytes)
    bits = _Bits(int(8 * nbytes.sum()))
    kind = 8 + o if v < 3 else 32 + o - 1
    bits.put(base, np.full(count, kind << 1), 8)
    at = base + 8
    for j in range(o):
        bits.put(at, x[:, j] & 0xFF, 8)
        at = at + 8
    if v >= 3:
        bits.put(at, np.full(count, PRECISION - 1), 4)
        bits.put(at + 4, shift, 5)
        at = at + 9
        for j in range(LPC_ORDER):
            bits.put(at, coefficients[:, j] & (1 << PRECISION) - 1, PRECISION)
            at = at + PRECISION
    bits.put(at, np.full(count, k), 10)  # method 0, partition order 0, parameter k
    stops = (base + head)[:, None] + ends - k - 1
    bits.bits[stops] = 1
    low = fold[:, o:]
    for i in range(k):
        bits.bits[stops + 1 + i] = low >> (k - 1 - i) & 1
    data = np.packbits(bits.bits).tobytes()
    cuts = (base // 8).tolist()
    return [data[a : a + s] for a, s in zip(cuts, nbytes.tolist(), strict=True)]


class FlacError(ValueError):
    """A stream that isn't FLAC of one 8-bit channel, or whose checksums don't hold."""


def _opened(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples in all, MD5, seek points (maybe none), where the first frame starts."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC mark")
    at, last, info, points = 4, False, b"", np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the stream ends in its heads")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body[: size - size % 18], points.dtype)
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if len(info) < 34 or packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise FlacError("not one channel of 8 bits")
    return packed & (1 << 36) - 1, info[18:34], points[points["sample"] < 1 << 63], at


def _head_at(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(number, samples, bytes) of a frame's head of fixed blocks, if one that holds stands here; samples 0: as many as its stream says."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] != 0xF8 or data[at + 3] & 1:
        return None
    lead, code, pos = data[at + 4], data[at + 2] >> 4, at + 5
    extra = 0 if lead < 0x80 else next((n for n, top in enumerate((0xE0, 0xF0, 0xF8, 0xFC, 0xFE), 1) if 0xC0 <= lead < top), 6)
    number = lead if not extra else lead & (0x3F >> extra)
    for b in data[pos : pos + extra]:
        number = number << 6 | b & 0x3F
    pos += extra
    if code == 0 or pos + 3 > len(data):
        return None
    if code == 6:
        samples, pos = data[pos] + 1, pos + 1
    elif code == 7:
        samples, pos = (data[pos] << 8 | data[pos + 1]) + 1, pos + 2
    else:
        samples = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
    return (number, samples, pos + 1 - at) if pos < len(data) and crc8(data[at:pos]) == data[pos] else None


def frames_of(stream: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Samples in all, MD5, and each frame's start, size and samples.

    Where every frame has a seek point these tell; else frames are found by their sync codes: the next one begins where a head with
    the next number stands and the frame before it has its checksum.
    """
    total, digest, points, at = _opened(stream)
    n = points["n"].astype(np.int64)
    if int(n.sum()) == total and len(points):
        start = points["offset"].astype(np.int64) + at
        return total, digest, start, np.diff(np.append(start, len(stream))), n
    data = np.frombuffer(stream, np.uint8)
    here = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] == 0xF8)) + at
    heads = [(int(p), h) for p in here.tolist() if (h := _head_at(stream, p))]
    by_number: dict[int, list[int]] = {}
    for i, (_, (number, _, _)) in enumerate(heads):
        by_number.setdefault(number, []).append(i)
    start, size, samples = [], [], []
    now = next((i for i in by_number.get(0, []) if heads[i][0] == at), None)
    while now is not None:
        begin, (number, held, _) = heads[now]
        after = [i for i in by_number.get(number + 1, []) if heads[i][0] > begin]
        ends = [*(heads[i][0] for i in after), len(stream)]
        whole = crc16(data, np.full(len(ends), begin), np.array(ends) - begin) == 0
        if not whole.any():
            raise FlacError("a frame's CRC-16 doesn't hold")
        pick = int(np.argmax(whole))
        start.append(begin)
        size.append(ends[pick] - begin)
        samples.append(held)
        now = after[pick] if pick < len(after) else None
    if sum(samples) != total:
        raise FlacError("frames are missing")
    return total, digest, np.array(start, np.int64), np.array(size, np.int64), np.array(samples, np.int64)


def _read(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width (16 at most) bits at each bit position."""
    byte = at >> 3
    word = (data[byte].astype(np.int32) << 16) | (data[byte + 1].astype(np.int32) << 8) | data[byte + 2]
    return word >> (24 - width - (at & 7)) & ((1 << width) - 1)


#: Leading zeros of a 16-bit window, 16 where it is empty.
_ZEROS = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def _samples(data: np.ndarray, start: np.ndarray, size: np.ndarray, samples: np.ndarray, verify: bool) -> bytes:
    """PCM (unsigned) of some frames in their order; ``data`` goes on for 8 bytes after the last."""
    if verify and crc16(data, start, size).any():  # with its own sum at the end a frame comes to zero
        raise FlacError("a frame's CRC-16 doesn't hold")
    out = np.zeros(int(samples.sum()), np.int16)
    _subframes(data, _headers(data, start, samples) * 8, samples, out, np.cumsum(samples) - samples)
    return ((out & 0xFF).astype(np.uint8) ^ np.uint8(0x80)).tobytes()


def blocks(streams: list[bytes], verify: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(stream, sample offset, PCM) of consecutive blocks of every stream, a slice of frames at a time; raises FlacError where a checksum doesn't hold."""
    opened = [frames_of(s) for s in streams]
    owner = np.repeat(np.arange(len(streams)), [len(o[2]) for o in opened])
    start, size, samples = (np.concatenate([o[k] for o in opened]) if opened else np.zeros(0, np.int64) for k in (2, 3, 4))
    sums = [hashlib.md5() for _ in streams]
    told = [0] * len(streams)
    for a in range(0, len(owner), SLICE):
        who = owner[a : a + SLICE]
        # The bytes of this slice alone, the frames of each stream one after the other.
        cut, at = [], start[a : a + SLICE].copy()
        base = 0
        for i in np.unique(who).tolist():
            mine = np.flatnonzero(who == i)
            lo, hi = int(at[mine[0]]), int(at[mine[-1]] + size[a + mine[-1]])
            cut.append(streams[i][lo:hi])
            at[mine] += base - lo
            base += hi - lo
        n = samples[a : a + SLICE]
        pcm = _samples(np.frombuffer(b"".join([*cut, bytes(8)]), np.uint8), at, size[a : a + SLICE], n, verify)
        ends = np.cumsum(n)
        for i in np.unique(who).tolist():
            mine = np.flatnonzero(who == i)
            part = pcm[int(ends[mine[0]] - n[mine[0]]) : int(ends[mine[-1]])]
            if verify:
                sums[i].update((np.frombuffer(part, np.uint8) ^ np.uint8(0x80)).tobytes())
            yield i, told[i], part
            told[i] += len(part)
    for (total, digest, *_), n, md5 in zip(opened, told, sums, strict=True):
        if n != total or verify and md5.digest() != digest:
            raise FlacError("the stream's length or MD5 doesn't hold")


def decoded(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """The payload of each stream; raises FlacError where a checksum doesn't hold."""
    parts: list[list[bytes]] = [[] for _ in streams]
    for i, _, pcm in blocks(streams, verify):
        parts[i].append(pcm)
    return [b"".join(p) for p in parts]


def read_samples(stream: bytes, offset: int, count: int) -> bytes:
    """``count`` samples from an offset on, or as many as there are: only the frames that hold them are decoded, and their checksums verified."""
    total, _, start, size, samples = frames_of(stream)
    ends = np.cumsum(samples)
    stop = min(total, offset + count)
    if not 0 <= offset < stop:
        return b""
    a, b = int(np.searchsorted(ends, offset, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    lo, hi = int(start[a]), int(start[b - 1] + size[b - 1])
    pcm = _samples(np.frombuffer(stream[lo:hi] + bytes(8), np.uint8), start[a:b] - lo, size[a:b], samples[a:b], True)
    skip = offset - int(ends[a] - samples[a])
    return pcm[skip : skip + stop - offset]


def _headers(data: np.ndarray, start: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Checks sync, block size, format and CRC-8 of all frames; where their subframes start."""
    if not len(start):
        return start
    if ((data[start] != 0xFF) | (data[start + 1] & 0xFE != 0xF8)).any():
        raise FlacError("a frame has no sync code")
    code, lead = data[start + 2] >> 4, data[start + 4]
    extra = np.where(lead < 0x80, 0, np.select([lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5], 6))
    at = start + 5 + extra
    eight, sixteen = data[at].astype(np.int64) + 1, (data[at].astype(np.int64) << 8 | data[at + 1]) + 1
    named = np.where(code == 1, 192, np.where(code <= 5, 576 << np.clip(code.astype(int) - 2, 0, 3), 256 << np.clip(code.astype(int) - 8, 0, 7)))
    told = np.where(code == 6, eight, np.where(code == 7, sixteen, named))
    if (told != samples).any() or (data[start + 2] & 15 >= 12).any() or (data[start + 3] >> 4).any():
        raise FlacError("a frame's header doesn't fit the stream's")
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    crc = np.zeros(len(start), np.uint16)
    for i in range(int((at - start).max())):
        on = start + i < at
        crc = np.where(on, _CRC8[(crc ^ data[np.minimum(start + i, at)]) & 0xFF], crc)
    if (crc != data[at]).any():
        raise FlacError("a frame header's CRC-8 doesn't hold")
    return at + 1


def _subframes(data: np.ndarray, at: np.ndarray, samples: np.ndarray, out: np.ndarray, out_at: np.ndarray) -> None:
    kind = _read(data, at, 8)
    if (kind & 0x81).any():
        raise FlacError("padding or wasted bits in a subframe's head")
    kind, at = kind >> 1, at + 8
    for t in np.unique(kind).tolist():
        for n in np.unique(samples[kind == t]).tolist():
            rows = np.flatnonzero((kind == t) & (samples == n))
            to = out_at[rows][:, None] + np.arange(n)
            if t == 0:
                out[to] = _read(data, at[rows], 8).astype(np.int8)[:, None]
            elif t == 1:
                out[to] = data[(at[rows] >> 3)[:, None] + np.arange(n)].astype(np.int8)
            elif 8 <= t <= 12 or t >= 32:
                out[to] = _predicted(data, at[rows], n, t).astype(np.int16)
            else:
                raise FlacError("a reserved subframe type")


_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _predicted(data: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Fixed and linear-predictor subframes of one order, a sample of each frame at a time."""
    order = kind - 8 if kind < 32 else kind - 31
    x = np.zeros((n, len(at)), np.int32)
    at = at.copy()
    for i in range(min(order, n)):
        x[i] = _read(data, at, 8).astype(np.int8)
        at += 8
    if kind < 32:
        coefficients, shift = [np.full(len(at), c) for c in _FIXED[order]], np.zeros(len(at), np.int64)
    else:
        precision = _read(data, at, 4) + 1
        shift = _read(data, at + 4, 5)
        at += 9
        coefficients = []
        for _ in range(order):
            raw = np.zeros(len(at), np.int64)
            for p in np.unique(precision).tolist():
                raw = np.where(precision == p, (_read(data, at, p) ^ 1 << (p - 1)) - (1 << (p - 1)), raw)
            coefficients.append(raw)
            at += precision
    method, parts = _read(data, at, 2), _read(data, at + 2, 4)
    at += 6
    if (method > 1).any():
        raise FlacError("a reserved residual code")
    first = _read(data, at, 4)
    if not parts.any() and not method.any() and (first < 15).all():
        r = _rice(data, at + 4, first, n - order)
    else:
        r = _partitions(data, at, np.where(method == 0, 4, 5), parts, n, order)
    if not order:
        return r.T
    x[order:] = r
    for i in range(order, n):
        guess = sum(c * x[i - 1 - j] for j, c in enumerate(coefficients))
        x[i] += guess >> shift if kind >= 32 else guess
    return x.T


def _rice(data: np.ndarray, at: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """n residuals of each frame, all of one parameter a frame: the common case, a window of 32 bits a sample."""
    wide = data.astype(np.uint32)
    words = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    out = np.empty((n, len(at)), np.int32)
    k32, fill = k.astype(np.uint32), (32 - k).astype(np.uint32)
    at = at.copy()
    for i in range(n):
        w = words.take(at >> 3) << (at & 7).astype(np.uint32)
        zeros = _ZEROS.take(w >> np.uint32(16))
        if ((zeros > 15) | (zeros + k > 23)).any():  # a unary part that the window doesn't hold
            long = zeros.astype(np.int64)
            more = long == 16
            while more.any():
                found = _ZEROS[_read(data, np.where(more, at + long, at), 16)]
                long = np.where(more, long + found, long)
                more &= found == 16
            w = words.take((at + long + 1) >> 3) << ((at + long + 1) & 7).astype(np.uint32)
            fold = (long << k) | (w >> fill)
            at += long + 1 + k
        else:
            fold = zeros.astype(np.uint32) << k32 | (w << (zeros + np.uint8(1)).astype(np.uint32)) >> fill
            at += zeros
            at += k + 1
        fold = fold.astype(np.int32)
        out[i] = (fold >> 1) ^ -(fold & 1)
    return out


def _partitions(data: np.ndarray, at: np.ndarray, wide: np.ndarray, parts: np.ndarray, n: int, order: int) -> np.ndarray:
    """Residuals with any partition order, either residual code and escaped partitions."""
    at = at.copy()
    k, raw_bits, out = np.zeros(len(at), np.int64), np.full(len(at), -1), np.zeros((n - order, len(at)), np.int32)
    for i in range(order, n):
        fresh = (i % np.maximum(n >> parts, 1) == 0) | (i == order)
        if fresh.any():
            got = np.where(wide == 4, _read(data, at, 4), _read(data, at, 5))
            k, at = np.where(fresh, got, k), at + np.where(fresh, wide, 0)
            escape = fresh & (got == (1 << wide) - 1)
            raw_bits = np.where(escape, _read(data, at, 5), np.where(fresh, -1, raw_bits))
            at = at + np.where(escape, 5, 0)
        zeros = _ZEROS[_read(data, at, 16)].astype(np.int64)
        more = (zeros == 16) & (raw_bits < 0)
        while more.any():
            found = _ZEROS[_read(data, np.where(more, at + zeros, at), 16)]
            zeros = np.where(more, zeros + found, zeros)
            more &= found == 16
        kk = np.where(raw_bits < 0, k, 0)
        low = np.zeros(len(at), np.int64)
        for width in np.unique(kk).tolist():
            if width:
                low = np.where(kk == width, _read(data, at + zeros + 1, width), low)
        fold = zeros << kk | low
        raw = word_at(data, at, np.maximum(raw_bits, 0))
        out[i - order] = np.where(raw_bits < 0, (fold >> 1) ^ -(fold & 1), raw)
        at = at + np.where(raw_bits < 0, zeros + 1 + kk, raw_bits)
    return out


def word_at(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Signed numbers of width bits (16 at most, 0: zero) each."""
    byte = at >> 3
    word = (data[byte].astype(np.int64) << 16) | (data[byte + 1].astype(np.int64) << 8) | data[byte + 2]
    raw = word >> (24 - width - (at & 7)) & ((1 << width) - 1)
    return np.where(width > 0, raw - (raw >> np.maximum(width - 1, 0) << width), 0)


def padded(data: bytes) -> bytes:
    """With spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 as a FLAC stream.

    A null or empty text is one unit of spaces; repeated rows are told each; an empty table gives no rows. A text of any length is
    one stream; it is coded in slices, so memory beyond the text and the stream is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                raw = text_bytes(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encoded([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return plain_columns(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = 8 * BLOCK) -> DataFrame:
    """(doc_id, sample_offset, pcm): decoded blocks of ``samples`` samples (the last of a stream has fewer), so that a reader can seek by offset.

    Rows without a stream have no blocks; a stream that isn't FLAC, or whose checksums don't hold, is an error. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "media", CHUNK):
                ids, rest, begin = batch.column(0).to_pylist(), b"", 0
                last = None
                for i, offset, pcm in blocks(batch.column(1).to_pylist()):
                    if i != last:
                        if rest:
                            yield _block_rows(ids[last], begin, rest, samples)
                        rest, begin, last = b"", offset, i
                    rest += pcm
                    full = len(rest) - len(rest) % samples
                    if full:
                        yield _block_rows(ids[i], begin, rest[:full], samples)
                        rest, begin = rest[full:], begin + full
                if rest:
                    yield _block_rows(ids[last], begin, rest, samples)

    return plain_columns(media.where("media is not null"), "doc_id", "media").mapInArrow(tidy(run), "doc_id long, sample_offset long, pcm binary")


def _block_rows(doc_id: int | None, begin: int, pcm: bytes, samples: int) -> pa.RecordBatch:
    at = range(0, len(pcm), samples)
    return pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), pa.int64()), pa.array([begin + a for a in at], pa.int64()), pa.array([pcm[a : a + samples] for a in at], pa.binary())], ["doc_id", "sample_offset", "pcm"])


class _Told:
    """What is told of a payload, gathered block by block."""

    def __init__(self) -> None:
        self.digest, self.tail, self.n, self.total, self.squares, self.peak, self.crossings, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        self.digest.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
        below = x < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])
        self.n += len(x)
        self.total += int(x.sum())
        self.squares += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))

    def feature(self) -> str:
        return f"n={self.n};mean={self.total / self.n:.3f};rms={(self.squares / self.n) ** 0.5:.3f};peak={self.peak};zero_crossings={self.crossings}"


def media_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row.

    The payload's figures are of the blocks that the stored stream decodes to. A null or empty text is one unit of spaces;
    repeated rows are told each; an empty table gives no rows; other columns aren't looked at. For very long texts see ``media_column``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "media", CHUNK):
                media = batch.column(2).to_pylist()
                told = [_Told() for _ in media]
                for i, _, pcm in blocks(media):
                    told[i].add(pcm)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([t.n for t in told], pa.int64()), pa.array([t.digest.hexdigest() for t in told], pa.string()), pa.array([zlib.crc32(t.tail) for t in told], pa.int64()),
                     pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), pa.array([t.feature() for t in told], pa.string())],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media_column(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
