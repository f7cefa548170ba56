"""Media columns (operator 2): FLAC streams in a binary column.

Bytes are stored as one channel of 8-bit samples (byte - 128) in frames of 192.
Every frame has a seek point, so any sample can be reached without reading what
stands before it, and the frames of a batch are decoded side by side: one numpy
step reads the n-th Rice code of all frames and adds their predictions.

Encoding picks, per frame, a constant, verbatim samples, a fixed predictor of
order 0 to 2, or a quantised linear predictor of order 8, whichever is smallest.
Decoding checks the CRC-8 of each frame header, the CRC-16 of each frame and the
MD5 of the samples, and raises ValueError where one of them is wrong.

Edge cases: a null or empty text is a payload of 192 spaces; texts are taken
whole, the longest as a piece of its own; equal texts give equal streams; each of repeated
rows, and of rows without an id, has its own; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map

BLOCK = 192
ORDER, PRECISION, SHIFT = 8, 12, 10
SAMPLE_RATE = 8000
#: Payload bytes that are encoded or decoded at a time (a longer text is one piece).
PIECE_BYTES = 2 << 20
_HEAD = 4 + 4 + 34 + 4
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        table.append(crc)
    return np.array(table, dtype=np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zeros of a 16-bit number.
_ZEROS16 = np.array([16 - int(n).bit_length() for n in range(1 << 16)], dtype=np.uint8)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC of many byte ranges at once; zeros in front don't change a CRC that begins at 0,
    so the ranges are aligned at their ends."""
    crc = np.zeros(len(starts), dtype=table.dtype)
    if not len(starts):
        return crc
    longest = int(lengths.max())
    ends = starts + lengths
    for j in range(longest, 0, -1):
        at = ends - j
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint8)
        if table.dtype == np.uint8:
            crc = table[crc ^ byte]
        else:
            crc = (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)).astype(np.uint8) ^ byte]
    return crc


def _frame_headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes of frames with these numbers, zero-padded to 10, and their lengths
    (without the CRC-8)."""
    n = len(numbers)
    out = np.zeros((n, 10), dtype=np.uint8)
    out[:, :4] = (0xFF, 0xF8, 0x10, 0x02)  # fixed block size, 192 samples, rate of the stream, one channel of 8 bits
    lengths = np.full(n, 5, dtype=np.int64)
    small = numbers < 0x80
    out[small, 4] = numbers[small]
    for extra in range(1, 6):
        low, high = (0x80 if extra == 1 else 1 << (5 * extra + 1)), 1 << (5 * extra + 6)
        mine = (numbers >= low) & (numbers < high)
        if not mine.any():
            continue
        v = numbers[mine]
        lead = (0xFF << (6 - extra)) & 0xFF
        out[mine, 4] = lead | (v >> (6 * extra))
        for k in range(extra):
            out[mine, 5 + k] = 0x80 | ((v >> (6 * (extra - 1 - k))) & 0x3F)
        lengths[mine] = 5 + extra
    return out, lengths


def _linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [ORDER, frames] of samples [BLOCK, frames], and which are usable.

    Autocorrelations are whole numbers and each later step is element by element, so
    a frame's coefficients don't depend on the frames beside it.
    """
    auto = [(x[lag:] * x[: BLOCK - lag]).sum(axis=0, dtype=np.int64).astype(np.float64) for lag in range(ORDER + 1)]
    frames = x.shape[1]
    good = auto[0] > 0
    error = np.where(good, auto[0] * (1 + 1e-9), 1.0)
    a = np.zeros((ORDER, frames))
    for i in range(ORDER):
        acc = auto[i + 1].copy()
        for j in range(i):
            acc -= a[j] * auto[i - j]
        reflection = acc / error
        before = a[:i].copy()
        a[i] = reflection
        for j in range(i):
            a[j] = before[j] - reflection * before[i - 1 - j]
        error = error * (1 - reflection * reflection)
        good &= error > 1e-6
        error = np.where(good, error, 1.0)
    q = np.rint(a * (1 << SHIFT))
    limit = 1 << (PRECISION - 1)
    good &= (np.abs(q) < limit).all(axis=0)
    return np.where(good, q, 0).astype(np.int32), good


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of residuals [n, frames] and the bits that it takes."""
    z = _zigzag(r)
    n = len(z)
    best = np.full(z.shape[1], 1 << 40, dtype=np.int64)
    param = np.zeros(z.shape[1], dtype=np.int64)
    # the best parameter lies within one of the logarithm of the mean
    mean = z.sum(axis=0, dtype=np.int64) // n
    guess = np.maximum(np.frexp(mean.astype(np.float64))[1] - 1, 0)
    for step in (-1, 0, 1):
        k = np.maximum(guess + step, 0).astype(np.int32)
        bits = (z >> k).sum(axis=0, dtype=np.int64) + n * (1 + k)
        better = bits < best
        best, param = np.where(better, bits, best), np.where(better, k, param)
    return param, best


def _put(out: np.ndarray, values: np.ndarray, lengths: np.ndarray, first_bit: np.ndarray) -> None:
    """Write fields [n, frames] of up to 16 significant bits into out, 32-bit words; each
    frame's fields follow each other from its first bit.  lengths count leading zeros too."""
    end = first_bit.copy()
    for value, length in zip(values, lengths, strict=True):
        # at one step frames write to words of their own: their bodies lie 8 bytes apart at least
        end += length
        word, moved = (end - 1) >> 5, value << (-end & 31)
        out[word] |= moved & 0xFFFFFFFF
        over = np.flatnonzero(moved >> 32)
        out[word[over] - 1] |= moved[over] >> 32


def encode_frames(payload: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of a payload (a multiple of BLOCK bytes) and each frame's length."""
    x = np.ascontiguousarray(payload.reshape(-1, BLOCK).T).astype(np.int32) - 128
    frames = x.shape[1]
    heads, head_len = _frame_headers(numbers)
    # bits of each way to store a frame's samples; the subframe header has 8 in any
    cost = np.full((6, frames), 1 << 40, dtype=np.int64)
    params = np.zeros((6, frames), dtype=np.int64)
    constant = (x == x[0]).all(axis=0)
    cost[0] = np.where(constant, 16, 1 << 40)
    cost[1] = 8 + 8 * BLOCK
    residuals = {}
    r = x
    for order in range(3):
        if order:
            r = r[1:] - r[:-1]
        residuals[2 + order] = r
        params[2 + order], bits = _rice(r)
        cost[2 + order] = 8 + 8 * order + 10 + bits
    coefs, usable = _linear_predictors(x)
    predicted = np.zeros((BLOCK - ORDER, frames), dtype=np.int32)
    for j in range(ORDER):
        predicted += coefs[j] * x[ORDER - 1 - j : BLOCK - 1 - j]
    residuals[5] = x[ORDER:] - (predicted >> SHIFT)
    params[5], bits = _rice(residuals[5])
    cost[5] = np.where(usable, 8 + 8 * ORDER + 9 + PRECISION * ORDER + 10 + bits, 1 << 40)
    way = cost.argmin(axis=0)
    body = (cost[way, np.arange(frames)] + 7) >> 3
    lengths = head_len + 1 + body + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    starts, total = starts[:-1], int(starts[-1])
    words = np.zeros((total >> 2) + 2, dtype=np.int64)
    for w in np.unique(way):
        mine = np.flatnonzero(way == w)
        first = (starts[mine] + head_len[mine] + 1) * 8
        xs = x[:, mine] & 0xFF
        one = np.ones((1, len(mine)), dtype=np.int64)
        if w == 0:
            values, sizes = [0 * one, xs[:1]], [8 * one, 8 * one]
        elif w == 1:
            values, sizes = [2 * one, xs], [8 * one, np.full(xs.shape, 8)]
        else:
            order = ORDER if w == 5 else int(w) - 2
            kind = (0x20 | (ORDER - 1)) if w == 5 else (0x08 | order)
            values, sizes = [(kind << 1) * one, xs[:order]], [8 * one, np.full((order, len(mine)), 8)]
            if w == 5:
                values += [(PRECISION - 1) * one, SHIFT * one, coefs[:, mine] & ((1 << PRECISION) - 1)]
                sizes += [4 * one, 5 * one, np.full((ORDER, len(mine)), PRECISION)]
            k = params[w, mine]
            z = _zigzag(residuals[int(w)][:, mine]).astype(np.int64)
            values += [0 * one, k[None], (1 << k) | (z & ((1 << k) - 1))]  # Rice codes of 4-bit parameters, one partition
            sizes += [6 * one, 4 * one, (z >> k) + 1 + k]
        _put(words, np.concatenate(values), np.concatenate(sizes), first)
    out = words.astype(">u4").view(np.uint8)
    for j in range(10):
        on = j < head_len
        out[starts[on] + j] = heads[on, j]
    out[starts + head_len] = _crc(out, starts, head_len, _CRC8)
    crc = _crc(out, starts, lengths - 2, _CRC16)
    out[starts + lengths - 2] = crc >> 8
    out[starts + lengths - 1] = crc & 0xFF
    return out[:total], lengths


#: Bytes of seek points in one metadata block: its length has 24 bits.
BLOCK_POINTS = 18 * 900_000
#: Marks the application blocks that hold the points after the first block's.
_MORE = b"pnts"


def _point_blocks(points: bytes) -> bytes:
    """The seek table, and application blocks for the points that are too many for it."""
    parts = [points[a : a + BLOCK_POINTS] for a in range(0, len(points), BLOCK_POINTS)]
    bodies = [(3, parts[0]), *((2, _MORE + p) for p in parts[1:])]
    return b"".join(bytes([kind | 0x80 * (i == len(bodies) - 1)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(bodies))


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream, with a seek point for each frame, of each payload."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
    data, lengths = encode_frames(np.frombuffer(b"".join(payloads), dtype=np.uint8), numbers)
    raw = data.tobytes()
    ends = np.cumsum(lengths)
    streams, first = [], 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        mine = lengths[first : first + count]
        begin = int(ends[first] - lengths[first])
        offsets = ends[first : first + count] - mine - begin
        points = np.zeros(count, dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        points["sample"], points["offset"], points["samples"] = np.arange(count) * BLOCK, offsets, BLOCK
        samples = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        packed = (SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(mine.min()).to_bytes(3, "big") + int(mine.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
        streams.append(b"fLaC" + b"\x00\x00\x00\x22" + info + _point_blocks(points.tobytes()) + raw[begin : begin + int(mine.sum())])
        first += count
    return streams


class _Bits(NamedTuple):
    """Reads up to 25 bits anywhere in a byte string, at many places at once."""

    words: np.ndarray

    @classmethod
    def over(cls, data: np.ndarray) -> _Bits:
        b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        n = len(data) + 4
        return cls((b[:n] << 24) | (b[1 : n + 1] << 16) | (b[2 : n + 2] << 8) | b[3 : n + 3])

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def get(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at) >> np.uint32(32 - n)).astype(np.int32)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.window(at).view(np.int32) >> np.int32(32 - n)


def _residuals(bits: _Bits, at: np.ndarray, n: int, order: int) -> np.ndarray:
    """Rice-coded residuals [n - order, frames] from bit positions at, which move on."""
    out = np.empty((n - order, len(at)), dtype=np.int32)
    method = bits.get(at, 2)
    if (method > 1).any():
        raise ValueError("reserved residual coding method")
    parts = bits.get(at + 2, 4)
    at += 6
    for p in np.unique(parts):
        for m in np.unique(method):
            on = np.flatnonzero((parts == p) & (method == m))
            if not len(on):
                continue
            here, width = at[on], 4 + int(m)
            samples = np.empty((n - order, len(on)), dtype=np.int32)
            row = 0
            for part in range(1 << int(p)):
                k = bits.get(here, width).astype(np.uint32)
                here += width
                raw = k == (1 << width) - 1
                size = (n >> int(p)) - (order if part == 0 else 0)
                plain = None
                if raw.any():  # escaped: samples of a stated width
                    plain = np.where(raw, bits.get(here, 5), 0)
                    here += 5 * raw
                    k[raw] = 0
                step, rest = np.uint32(1) + k, np.uint32(31) - k
                for _ in range(size):
                    w = bits.window(here)
                    q = _ZEROS16[w >> np.uint32(16)].astype(np.uint32)
                    far = (q + step > 25) | (q == 16)
                    value = (q << k) | ((w << (q + np.uint32(1))) >> rest >> np.uint32(1))
                    move = (q + step).astype(np.int64)
                    if far.any():
                        value, move = _far(bits, here, k, value, move, np.flatnonzero(far))
                    code = value.astype(np.int32)
                    samples[row] = (code >> 1) ^ -(code & 1)
                    if plain is not None:
                        for i in np.flatnonzero(raw):
                            samples[row, i] = bits.signed(here[i : i + 1], int(plain[i]))[0] if plain[i] else 0
                            move[i] = plain[i]
                    here += move
                    row += 1
            out[:, on], at[on] = samples, here
    return out


def _far(bits: _Bits, here: np.ndarray, k: np.ndarray, value: np.ndarray, move: np.ndarray, far: np.ndarray):
    """Codes whose zeros or low bits reach past one window."""
    at, kk = here[far].copy(), k[far]
    q = np.zeros(len(far), dtype=np.uint32)
    open_ = np.arange(len(far))
    while len(open_):
        z = _ZEROS16[bits.window(at[open_]) >> np.uint32(16)]
        q[open_] += z
        at[open_] += z
        open_ = open_[z == 16]
        if len(open_) and (at[open_] >> 3).max() >= len(bits.words) - 4:
            raise ValueError("a Rice code runs past the end")
    at += 1
    low = bits.window(at) >> (np.uint32(31) - kk) >> np.uint32(1)
    value[far] = (q << kk) | low
    move[far] = q.astype(np.int64) + 1 + kk
    return value, move


def decode_frames(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples [frames, BLOCK] as unsigned bytes of the frames at these places."""
    if not len(starts):
        return np.zeros((0, BLOCK), np.uint8)
    expected, head_len = _frame_headers(numbers)
    for j in range(10):
        on = j < head_len
        if (data[starts[on] + j] != expected[on, j]).any():
            raise ValueError("a frame header isn't of a mono 8-bit frame of 192 samples with its number")
    if (_crc(data, starts, head_len, _CRC8) != data[starts + head_len]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    stored = (data[starts + lengths - 2].astype(np.uint16) << 8) | data[starts + lengths - 1]
    if (_crc(data, starts, lengths - 2, _CRC16) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    bits = _Bits.over(data)
    at = (starts + head_len + 1) * 8
    kinds = bits.get(at, 8)
    at += 8
    out = np.empty((BLOCK, len(starts)), dtype=np.int32)
    for kind in np.unique(kinds):
        on, kind = np.flatnonzero(kinds == kind), int(kind)
        here, code = at[on], kind >> 1
        if kind & 0x81:
            raise ValueError("wasted bits or a reserved subframe header")
        if code == 0:
            out[:, on] = bits.signed(here, 8)
        elif code == 1:
            for i in range(BLOCK):
                out[i, on] = bits.signed(here + 8 * i, 8)
        elif code & 0x20 or 8 <= code <= 12:
            order = (code & 0x1F) + 1 if code & 0x20 else code - 8
            x = np.empty((BLOCK, len(on)), dtype=np.int32)
            for i in range(order):
                x[i] = bits.signed(here, 8)
                here += 8
            if code & 0x20:
                precision = bits.get(here, 4) + 1
                shift = bits.signed(here + 4, 5)
                here += 9
                coefs = np.empty((order, len(on)), dtype=np.int32)
                for j in range(order):
                    coefs[j] = bits.window(here).view(np.int32) >> (32 - precision)
                    here += precision
            else:
                shift = np.zeros(len(on), dtype=np.int32)
                coefs = np.repeat(np.array(_FIXED[order], dtype=np.int32)[:, None], len(on), axis=1)
            r = _residuals(bits, here, BLOCK, order)
            for i in range(order, BLOCK):
                acc = np.zeros(len(on), dtype=np.int32)
                for j in range(order):
                    acc += coefs[j] * x[i - 1 - j]
                x[i] = r[i - order] + (acc >> shift)
            out[:, on] = x
        else:
            raise ValueError("a reserved subframe type")
    return np.ascontiguousarray((out + 128).astype(np.uint8).T)


class Stream(NamedTuple):
    """Where the frames of a stream lie: places and lengths count from its first byte."""

    samples: int
    md5: bytes
    offsets: np.ndarray
    lengths: np.ndarray


def read_head(stream: bytes) -> Stream:
    """STREAMINFO and the seek points, one for each frame."""
    if stream[:4] != b"fLaC" or stream[4:8] != b"\x00\x00\x00\x22" or stream[42:43] not in (b"\x83", b"\x03"):
        raise ValueError("not a FLAC stream with a seek table")
    packed = int.from_bytes(stream[18:26], "big")
    at, last, parts = 42, False, []
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        parts.append(stream[at + 4 + len(_MORE) * (kind & 0x7F == 2) : at + 4 + size])
        at, last = at + 4 + size, kind >= 0x80
        if at > len(stream):
            raise ValueError("the seek table doesn't fit the stream")
    points = np.frombuffer(b"".join(parts), dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    offsets = points["offset"].astype(np.int64) + at
    lengths = np.diff(np.append(offsets, len(stream)))
    if len(points) * BLOCK != packed & ((1 << 36) - 1) or (lengths < 9).any():
        raise ValueError("the seek table doesn't fit the stream")
    return Stream(len(points) * BLOCK, stream[26:42], offsets, lengths)


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, all its checksums verified."""
    heads = [read_head(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    if not heads:
        return []
    starts = np.concatenate([h.offsets + b for h, b in zip(heads, base[:-1], strict=True)])
    lengths = np.concatenate([h.lengths for h in heads])
    numbers = np.concatenate([np.arange(len(h.offsets)) for h in heads])
    flat = decode_frames(data, starts, lengths, numbers).reshape(-1)
    out, first = [], 0
    for h in heads:
        own = flat[first : first + h.samples]
        if hashlib.md5((own ^ 0x80).tobytes()).digest() != h.md5:
            raise ValueError("the MD5 of the samples is wrong")
        out.append(own.tobytes())
        first += h.samples
    return out


def seek(stream: bytes, sample: int, n: int) -> bytes:
    """n samples from sample on, of which only the frames that hold them are decoded."""
    h = read_head(stream)
    first, last = sample // BLOCK, min(-(-(sample + n) // BLOCK), len(h.offsets))
    part = decode_frames(np.frombuffer(stream, dtype=np.uint8), h.offsets[first:last], h.lengths[first:last], np.arange(first, last)).reshape(-1)
    return part[sample - first * BLOCK :][:n].tobytes()


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Slices of neighbours that have PIECE_BYTES together, or one larger one."""
    first = total = 0
    for i, s in enumerate(sizes):
        if i > first and total + s > PIECE_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += s
    if first < len(sizes):
        yield slice(first, len(sizes))


def pad(raw: bytes) -> bytes:
    """Spaces (32) appended up to a positive multiple of BLOCK."""
    return raw.ljust(max(-(-len(raw) // BLOCK), 1) * BLOCK)


def flac_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text) and media (the stream)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            for part in _groups([len(t) for t in texts]):
                streams = encode_streams([pad(t) for t in texts[part]])
                sizes = pa.array([len(t) for t in texts[part]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], sizes, pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), encode, f"doc_id {kind}, n_bytes bigint, media binary")


#: Samples of a PCM block.
PCM_SAMPLES = 24 * BLOCK


def pcm_blocks(payload: bytes, block_samples: int = PCM_SAMPLES) -> list[tuple[int, bytes]]:
    """Sample offset and samples of each block of a decoded stream."""
    return [(at, payload[at : at + block_samples]) for at in range(0, len(payload), block_samples)]


def flac_blocks(media: DataFrame, block_samples: int = PCM_SAMPLES) -> DataFrame:
    """PCM blocks of decoded streams: doc_id, sample_offset, n_samples, pcm; a block can be
    found by its offset, and blocks of one stream joined in offset order are its payload."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _groups([len(s) for s in streams]):
                rows = [(i, at, pcm) for i, p in zip(ids[part], decode_streams(streams[part]), strict=True) for at, pcm in pcm_blocks(p, block_samples)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], batch.column(0).type),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([len(r[2]) for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["doc_id", "sample_offset", "n_samples", "pcm"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return arrow_map(media.select("doc_id", "media"), blocks, f"doc_id {kind}, sample_offset bigint, n_samples bigint, pcm binary")


def feature(payload: bytes) -> str:
    """Mean, root mean square and peak of the samples, and sign changes per sample."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / len(x):.6f} rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f} peak={int(np.abs(x).max())} crossings={crossings / len(x):.6f}"


def flac_features(media: DataFrame) -> DataFrame:
    """Decode each stream of media (doc_id, n_bytes, media) into PCM blocks and describe what was
    read back; blocks: the blocks' sample offsets, sizes and checksums."""
    block_type = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("crc32", pa.int64())]))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for part in _groups([len(s) for s in streams]):
                own = streams[part]
                blocks = [pcm_blocks(p) for p in decode_streams(own)]
                payloads = [b"".join(pcm for _, pcm in x) for x in blocks]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(1)[part],
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                        pa.array([len(s) for s in own], pa.int64()),
                        pa.array([hashlib.sha256(s).hexdigest() for s in own]),
                        pa.array([feature(p) for p in payloads]),
                        pa.array([[{"sample_offset": at, "n_samples": len(pcm), "crc32": zlib.crc32(pcm)} for at, pcm in x] for x in blocks], block_type),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, blocks array<struct<sample_offset:bigint,n_samples:bigint,crc32:bigint>>"
    return arrow_map(media.select("doc_id", "n_bytes", "media"), describe, schema)


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_features(flac_encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
