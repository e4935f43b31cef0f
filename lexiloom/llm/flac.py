"""FLAC streams of 8-bit mono samples: encoding, and decoding into PCM blocks.

A stream holds STREAMINFO with the MD5 of its samples, a seek table with a point
for every frame (every so many frames where that many points don't fit a table,
so from about half a billion samples on), and frames of ``BLOCK`` samples. A frame is constant, verbatim,
or predicted (a fixed or a quantised linear predictor) with Rice-coded residuals.
The decoder takes many frames at a time and steps through their bits side by
side, one sample of every frame in a step. It checks the CRC-8 of every frame
header, the CRC-16 of every frame and the MD5 of the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, whole_text

BLOCK = 4608
RATE = 8000
#: Frames that are decoded, and encoded, side by side.
LANES, WRITTEN = 1024, 128
ORDER = 12
PRECISION = 10
#: Bytes of a seek table are fewer: the format's length field has 24 bits. PCM blocks have every offset all the same.
SEEK_BYTES = 1 << 24
_CODE = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}
#: The format's fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    """Remainders after each byte, most significant bit first."""
    table = np.arange(256) << (width - 8)
    for _ in range(8):
        table = (table << 1) ^ np.where(table >> (width - 1) & 1, polynomial, 0)
        table &= (1 << width) - 1
    return table


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
#: The remainder after two more bytes, by the old remainder xor those bytes.
_CRC16_PAIR = (_CRC16[_CRC16[np.arange(1 << 16) >> 8] >> 8 ^ (np.arange(1 << 16) & 255)] ^ ((_CRC16[np.arange(1 << 16) >> 8] & 255) << 8)).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of bytes, two bytes of each in a step."""
    crc = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return crc
    sizes = ends - starts
    odd = sizes % 2 == 1
    pairs = sizes // 2
    crc[odd] = _CRC16[data[starts[odd]]]
    order = np.argsort(-pairs, kind="stable")
    crc = crc[order]
    pair = np.zeros(len(data), np.uint16)
    pair[:-1] = data[:-1].astype(np.uint16) << 8 | data[1:]
    steps = int(pairs.max())
    at = ends[order] - 2 * steps
    for k, n in enumerate(np.searchsorted(-pairs[order], np.arange(-steps, 0), side="right").tolist()):
        crc[:n] = _CRC16_PAIR[crc[:n] ^ pair[at[:n] + 2 * k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


#: Unsigned samples as signed ones.
_SIGNED = bytes(i ^ 128 for i in range(256))


@lru_cache(1 << 16)
def _header(number: int, samples: int) -> bytes:
    code = _CODE.get(samples, 6 if samples <= 256 else 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _coded(number)
    if code == 6:
        head += bytes([samples - 1])
    elif code == 7:
        head += struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _coded(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >> (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size & 0xFF) | n, *tail[::-1]])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shift of each lane, by autocorrelation."""
    n, lanes = x.shape
    r = np.stack([np.einsum("ij,ij->j", x[: n - k], x[k:], dtype=np.float64) for k in range(ORDER + 1)])
    r[0] = r[0] * 1.001 + 1
    a, err = np.zeros((ORDER, lanes)), r[0].copy()
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err *= 1 - k * k
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(np.abs(a).max(axis=0), 1e-3))).astype(np.int32), 0, 15)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)), -top, top - 1).astype(np.int32), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def _frames(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the first ``sizes`` of each lane's 16-bit ``samples`` (zero after that), and their bytes."""
    n, lanes = samples.shape
    place = np.arange(n, dtype=np.int16)[:, None]
    live = place < sizes
    whole = bool(live.all())
    x = samples
    coefficients, shift = _linear(x.astype(np.float32))
    guess = np.zeros((n, lanes), np.int32)
    for j in range(ORDER):
        guess[j + 1 :] += coefficients[j] * x[: n - j - 1]
    guess >>= shift
    residuals = [x]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=0, prepend=np.int16(0)))
    left = x - guess
    too_far = np.abs(left).max(axis=0) > np.iinfo(np.int16).max
    residuals.append(left.astype(np.int16))
    orders = np.array([0, 1, 2, 3, 4, ORDER])
    # sums of what is to be coded; the few samples before the order count too, and those after the end are taken off
    weight = np.stack([np.abs(r if whole else np.where(live, r, 0)).sum(axis=0, dtype=np.int32) for r in residuals])
    count = np.maximum(sizes[None, :] - orders[:, None], 1)
    params = np.clip(np.floor(np.log2(np.maximum(2 * weight / count * 0.6931, 1e-9))).astype(np.int32) + 1, 0, 14)
    cost = 18 + (2 * weight >> params) - count // 2 + (1 + params) * count + 8 * orders[:, None]
    cost[5] += 9 + ORDER * PRECISION
    cost[5, too_far] = 1 << 30
    cost[orders[:, None] >= np.broadcast_to(sizes, cost.shape)] = 1 << 30
    kind = cost.argmin(axis=0)  # 0-4 fixed, 5 linear, 6 verbatim, 7 constant
    kind = np.where(cost.min(axis=0) >= 8 + 8 * sizes, 6, kind)
    kind = np.where(((x == x[0]) | ~live).all(axis=0), 7, kind)
    order = np.where(kind < 6, orders[np.minimum(kind, 5)], 0)
    coded = kind < 6
    z = np.zeros((n, lanes), np.int32)
    for c, residual in enumerate(residuals):
        own = np.flatnonzero(kind == c)
        v = residual[:, own].astype(np.int32)
        z[:, own] = v << 1 ^ v >> 31
    k = np.where(coded, params[np.minimum(kind, 5), np.arange(lanes)], 0).astype(np.int32)
    inside = live & (place >= order) & coded
    z *= inside
    heads = [_header(int(i), int(m)) for i, m in zip(numbers, sizes, strict=True)]
    head_bytes = np.array([len(h) for h in heads])
    q = z >> k
    lengths = (q + 1 + k) * inside
    upto = np.cumsum(lengths, axis=0, dtype=np.int32)
    total = upto[-1]
    prefix = 8 + 8 * order + np.where(kind == 5, 9 + ORDER * PRECISION, 0) + np.where(coded, 10, 0)
    body = np.where(kind == 7, 16, np.where(kind == 6, 8 + 8 * sizes, prefix + total))
    frame_bytes = head_bytes + (body + 7) // 8 + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    sub = (start + head_bytes) * 8
    _put(bits, sub, np.choose(kind, [8 << 1, 9 << 1, 10 << 1, 11 << 1, 12 << 1, (32 | ORDER - 1) << 1, 1 << 1, 0]), 8)
    raw = np.where(kind == 7, 1, np.where(kind == 6, sizes, order))  # samples that are stored as they are
    at, lane = np.nonzero(place < raw)
    _put(bits, sub[lane] + 8 + 8 * at, x[at, lane] & 255, 8)
    after = sub + 8 + 8 * order
    own = np.flatnonzero(kind == 5)
    _put(bits, after[own], np.full(len(own), PRECISION - 1), 4)
    _put(bits, after[own] + 4, shift[own], 5)
    for j in range(ORDER):
        _put(bits, after[own] + 9 + j * PRECISION, coefficients[j, own] & ((1 << PRECISION) - 1), PRECISION)
    after[own] += 9 + ORDER * PRECISION
    own = np.flatnonzero(coded)
    _put(bits, after[own] + 6, k[own], 4)  # one partition, parameters of four bits
    ends = upto  # where each code ends
    ends += (after + 10).astype(np.int32)
    for width in np.unique(k[own]).tolist():
        some = own[k[own] == width]
        mask = inside[:, some]
        stop, rest = ends[:, some][mask], z[:, some][mask]
        bits[stop - width - 1] = 1
        for b in range(width):
            bits[stop - 1 - b] = rest >> b & 1
    out = np.packbits(bits)
    for s, h in zip(start.tolist(), heads, strict=True):
        out[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(out, start, start + frame_bytes - 2)
    out[start + frame_bytes - 2], out[start + frame_bytes - 1] = crc >> 8, crc & 255
    return out.tobytes(), frame_bytes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each non-empty payload of unsigned 8-bit samples."""
    blocks = [(p, i, number) for p, data in enumerate(payloads) for number, i in enumerate(range(0, len(data), BLOCK))]
    blocks.sort(key=lambda b: len(payloads[b[0]]) - b[1])  # lanes of like sizes side by side; frames of a payload are put in order below
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for lo in range(0, len(blocks), WRITTEN):
        some = blocks[lo : lo + WRITTEN]
        taken = np.array([min(BLOCK, len(payloads[p]) - i) for p, i, _ in some])
        samples = np.full((len(some), taken.max()), 128, np.uint8)
        for lane, (p, i, _) in enumerate(some):
            samples[lane, : taken[lane]] = np.frombuffer(payloads[p], np.uint8, taken[lane], i)
        raw, sizes = _frames(np.ascontiguousarray(samples.T).astype(np.int16) - 128, taken, np.array([b[2] for b in some]))
        at = 0
        for (p, _, number), size in zip(some, sizes.tolist(), strict=True):
            frames[p][number] = raw[at : at + size]
            at += size
    return [_stream(data, [own[k] for k in range(len(own))]) for data, own in zip(payloads, frames, strict=True)]


def _stream(data: bytes, frames: list[bytes]) -> bytes:
    sizes = np.array([len(f) for f in frames])
    digest = hashlib.md5((np.frombuffer(data, np.uint8) ^ 128).tobytes(), usedforsecurity=False).digest()
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + digest
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    points["sample"] = np.arange(len(frames)) * BLOCK
    points["offset"] = np.cumsum(sizes) - sizes
    points["count"] = np.minimum(len(data) - np.arange(len(frames)) * BLOCK, BLOCK)
    if points.nbytes >= SEEK_BYTES:
        points = points[:: points.nbytes // SEEK_BYTES + 1]
    seek = points.tobytes()
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def _metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO and seek points, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out, last = 4, {"points": None}, False
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the stream ends within its metadata")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "channels": (packed >> 41 & 7) + 1, "width": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        at += 4 + size
    if "block" not in out or (out["channels"], out["width"]) != (1, 8):
        raise ValueError("only mono streams of 8-bit samples are read")
    return out, at


def _parse_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Frame number, samples, and where the subframe begins."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] != 0xF8:
        raise ValueError("no frame where one should be")
    code, size = head[2] >> 4, 4
    number = head[4]
    more = 0
    if number >= 0xC0:
        more = 8 - (number ^ 0xFF).bit_length() - 1
        number &= (1 << (6 - more)) - 1
        for b in head[5 : 5 + more]:
            number = number << 6 | b & 0x3F
    size = 5 + more
    samples = {1: 192, 6: head[size] + 1, 7: int.from_bytes(head[size : size + 2], "big") + 1}.get(code, 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0)
    size += (code == 6) + 2 * (code == 7)
    if not samples or crc8(head[:size]) != head[size]:
        raise ValueError("a frame header differs from its checksum")
    return number, samples, at + size + 1


def _starts(stream: bytes, info: dict, at: int) -> list[int]:
    """Where each frame begins: by the seek table if that has all, else by header checksums."""
    wanted = -(-info["samples"] // info["block"])
    points = info["points"]
    if points is not None and len(points) == wanted and (points["sample"] == np.arange(wanted) * info["block"]).all():
        return (points["offset"].astype(np.int64) + at).tolist()
    out: list[int] = []
    while len(out) < wanted:
        at = stream.find(b"\xff\xf8", at)
        if at < 0:
            raise ValueError("frames are missing")
        try:
            if _parse_header(stream, at)[0] == len(out):
                out.append(at)
        except ValueError:
            pass
        at += 2
    return out


class _Bits:
    """Side-by-side reading of bits at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        two = padded[:-1].astype(np.uint16) << 8 | padded[1:]
        four = two[:-2].astype(np.uint32) << 16 | two[2:]
        self.window = four[:-4].astype(np.uint64) << 32 | four[4:]
        bits = np.unpackbits(data).view(bool)
        self.next_one = np.full(len(bits), len(bits) - 1, np.int32)
        ones = np.flatnonzero(bits)
        self.next_one[ones] = ones
        backwards = self.next_one[::-1]
        np.minimum.accumulate(backwards, out=backwards)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Up to 56 bits from each place as unsigned numbers."""
        width = np.asarray(width, np.uint64)
        shifted = self.window[at >> 3] << (at & 7).astype(np.uint64)
        return (shifted >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)


def _signed(value: np.ndarray, width) -> np.ndarray:
    return value - ((value >> (width - 1) & 1) << width)


def _decode_frames(data: np.ndarray, sub: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples (place, lane) of frames whose subframes begin at ``sub``."""
    bits = _Bits(data)
    lanes, n = len(sub), int(sizes.max())
    at = sub * 8
    kind = bits.read(at, 8) >> 1
    if (bits.read(at, 8) & 1).any():
        raise ValueError("subframes with wasted bits are not read")
    at = at + 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    if not (linear | fixed | (kind <= 1)).all():
        raise ValueError("a subframe is of a reserved type")
    x = np.zeros((n, lanes), np.int64)
    raw = np.where(kind == 0, 1, np.where(kind == 1, sizes, order))
    for i in range(int(raw.max())):
        own = np.flatnonzero(raw > i)
        x[i, own] = _signed(bits.read(at[own], 8), 8)
        at[own] += 8
    constant = kind == 0
    top = int(order.max(initial=0))
    coefficients, shift = np.zeros((max(top, 1), lanes), np.int64), np.zeros(lanes, np.int64)
    for o, own in enumerate(FIXED[: top + 1]):
        for j, c in enumerate(own):
            coefficients[j, fixed & (order == o)] = c
    own = np.flatnonzero(linear)
    if len(own):
        precision = bits.read(at[own], 4) + 1
        shift[own] = _signed(bits.read(at[own] + 4, 5), 5)
        if (precision > 15).any() or (shift < 0).any():
            raise ValueError("a linear predictor is not valid")
        at[own] += 9
        for j in range(top):
            has = order[own] > j
            coefficients[j, own[has]] = _signed(bits.read(at[own[has]], precision[has]), precision[has])
            at[own[has]] += precision[has]
    coded = np.flatnonzero(linear | fixed)
    if len(coded):
        rice = np.zeros_like(x)
        _residuals(bits, at, rice, coded, order, sizes)
        x += rice >> 1 ^ -(rice & 1)
        backwards = np.ascontiguousarray(coefficients[:top][::-1])
        for i in range(1, n if top else 0):
            guess = np.einsum("ij,ij->j", backwards[max(0, top - i) :], x[max(0, i - top) : i])
            guess >>= shift
            if i < top:
                guess[order > i] = 0
            x[i] += guess
    x[:, constant] = x[0, constant]
    return x


def _residuals(bits: _Bits, at: np.ndarray, x: np.ndarray, coded: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> None:
    """Rice codes of the lanes ``coded`` into ``x`` as they are, from the place of their order on."""
    method = bits.read(at[coded], 2)
    if (method > 1).any():
        raise ValueError("a residual is of a reserved type")
    wide = 4 + method
    parts = bits.read(at[coded] + 2, 4)
    p, part = at[coded] + 6, sizes[coded] >> parts
    place, end = order[coded].copy(), sizes[coded]
    edge = place.copy()  # where the next parameter is due
    k = np.zeros(len(coded), np.int64)
    escaped = np.zeros(len(coded), bool)
    flat, lanes = x.reshape(-1), x.shape[1]
    window, next_one = bits.window, bits.next_one
    while True:
        on = np.flatnonzero(place < end)
        if not len(on):
            break
        if len(on) < len(place):
            coded, p, part, place, end, edge, k, escaped, wide = (v[on] for v in (coded, p, part, place, end, edge, k, escaped, wide))
        due = np.flatnonzero(place == edge)
        if len(due):
            k[due] = bits.read(p[due], wide[due])
            escaped[due] = k[due] == (1 << wide[due]) - 1
            p[due] += wide[due]
            edge[due] = np.minimum((place[due] // part[due] + 1) * part[due], end[due])
            out = due[escaped[due]]
            k[out] = bits.read(p[out], 5)
            p[out] += 5
        steps = int((edge - place).min())  # so many without a change of lanes or parameters
        to = place * lanes + coded
        right = (63 - k).astype(np.uint64)
        for _ in range(steps):
            if escaped.any():
                value = np.where(escaped, np.where(k > 0, _signed(bits.read(p, k), np.maximum(k, 1)), 0), 0)
                flat[to[escaped]] = (value << 1 ^ value >> 63)[escaped]
                some = np.flatnonzero(~escaped)
                one = next_one[p[some]].astype(np.int64)
                flat[to[some]] = one - p[some] << k[some] | bits.read(one + 1, k[some])
                p[escaped] += k[escaped]
                p[some] = one + 1 + k[some]
            else:
                one = next_one[p].astype(np.int64)
                quotient = one - p
                one += 1
                low = window[one >> 3] << (one & 7).view(np.uint64)
                low >>= 1
                low >>= right
                quotient <<= k
                quotient |= low.view(np.int64)
                flat[to] = quotient
                p = one + k
            to += lanes
        place += steps


def decode(streams: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(stream, frame, sample offset, unsigned 8-bit PCM) of every frame, in order.

    Raises ValueError where a header, a frame or all samples of a stream differ
    from their checksums.
    """
    frames: list[tuple[int, int, int, int, int, int]] = []
    infos = []
    for s, stream in enumerate(streams):
        info, at = _metadata(stream)
        infos.append(info)
        starts = _starts(stream, info, at)
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(stream)], strict=True)):
            got, samples, sub = _parse_header(stream, a)
            if got != number:
                raise ValueError("a frame is out of order")
            frames.append((s, number, a, b, sub, samples))
    by_size = sorted(range(len(frames)), key=lambda k: frames[k][5])  # lanes of like sizes side by side
    blocks: list[bytes] = [b""] * len(frames)
    for lo in range(0, len(frames), LANES):
        some = [frames[k] for k in by_size[lo : lo + LANES]]
        data = np.frombuffer(b"".join(streams[s][a:b] for s, _, a, b, _, _ in some), np.uint8)
        lengths = np.array([b - a for _, _, a, b, _, _ in some])
        starts = np.cumsum(lengths) - lengths
        if crc16(data, starts, starts + lengths).any():  # of a frame with its checksum: zero
            raise ValueError("a frame differs from its checksum")
        sizes = np.array([f[5] for f in some])
        x = _decode_frames(data, starts + np.array([sub - a for _, _, a, _, sub, _ in some]), sizes)
        pcm = (x + 128).astype(np.uint8).T
        for lane, k in enumerate(by_size[lo : lo + LANES]):
            blocks[k] = pcm[lane, : frames[k][5]].tobytes()
    last, md5, seen = -1, None, 0
    for (s, number, *_), block in zip(frames, blocks, strict=True):
        if s != last:
            last, md5, seen = s, hashlib.md5(usedforsecurity=False), 0
        md5.update(block.translate(_SIGNED))
        yield s, number, seen, block
        seen += len(block)
        if seen >= infos[s]["samples"] and (seen != infos[s]["samples"] or md5.digest() != infos[s]["md5"]):
            raise ValueError("the samples of a stream differ from their digest")


def _payload(text: str) -> bytes:
    data = text.encode("utf-8", "replace")
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _parts(pdf: pd.DataFrame, sizes: pd.Series) -> Iterator[pd.DataFrame]:
    """Slices of about a megabyte."""
    lo = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= LANES * BLOCK:
            yield pdf.iloc[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(pdf):
        yield pdf.iloc[lo:]


def to_media(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_bytes (of the text), media.

    The payload is the UTF-8 text, padded with spaces to a positive multiple of
    192; null counts as empty. Every row gets one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _parts(pdf, pdf["text"].str.len()):
                payloads = [_payload(t) for t in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"].array, "n_bytes": some["n_bytes"].array, "media": encode(payloads)})

    text = whole_text()
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return base.mapInPandas(rows, "doc_id string, n_bytes bigint, media binary").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the media column of ``docs`` to a table below the shared folder; returns that table.

    Equal streams near each other take little room in it, as pages are compressed.
    Null text is stored as an empty payload; rows with null or repeated ids are
    rows of their own; an empty table gives an empty one; other columns are not
    stored.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    to_media(docs).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def to_pcm_blocks(media: DataFrame, column: str = "media") -> DataFrame:
    """``media(doc_id, media)`` -> doc_id, block, sample_offset, n_samples, pcm.

    One row for every frame, so a sample is found by its offset. Null media give
    no rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _parts(pdf, pdf["media"].str.len()):
                ids = some["doc_id"].to_list()
                found = [(ids[s], number, offset, len(pcm), pcm) for s, number, offset, pcm in decode(some["media"].to_list())]
                yield pd.DataFrame(found, columns=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    base = media.where(F.col(column).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("media"))
    out = base.mapInPandas(rows, "doc_id string, block bigint, sample_offset bigint, n_samples bigint, pcm binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(media.schema["doc_id"].dataType))


def _feature(pcm: bytes) -> str:
    """Mean, root mean square and zero-crossing rate of the signed samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))
    return f"mean={x.mean():.4f},rms={np.sqrt((x * x).mean()):.4f},zcr={crossings / len(x):.4f}"


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Digest and features of every row's payload, as decoded from its stored stream.

    The streams are written to a table below the shared folder and read from it.
    Returns doc_id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32
    (of the last 16 payload bytes), media_bytes, media_sha256, n_blocks,
    offsets_crc32 (of the blocks' sample offsets as little-endian 64-bit integers)
    and feature (mean, root mean square, zero-crossing rate). Null and empty texts
    have a payload of 192 spaces; a null doc_id stays null; repeated rows each get
    a row; an empty table gives an empty result; other columns are ignored.
    """
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_blocks", "offsets_crc32", "feature"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _parts(pdf, pdf["media"].str.len()):
                blocks: list[list[bytes]] = [[] for _ in range(len(some))]
                offsets: list[list[int]] = [[] for _ in range(len(some))]
                for s, _, offset, pcm in decode(some["media"].to_list()):
                    blocks[s].append(pcm)
                    offsets[s].append(offset)
                out = []
                for doc_id, n_bytes, stream, own, at in zip(some["doc_id"], some["n_bytes"], some["media"], blocks, offsets, strict=True):
                    payload = b"".join(own)
                    out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), len(own), zlib.crc32(np.array(at, "<i8").tobytes()), _feature(payload)))
                yield pd.DataFrame(out, columns=columns)

    media = store_media(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = media.mapInPandas(rows, "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_blocks bigint, offsets_crc32 bigint, feature string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
