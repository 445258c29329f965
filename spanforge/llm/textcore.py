"""Text kernels over Arrow string columns: tokens, hashes and maps as NumPy arrays, never one Python object per word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8, U64 = np.uint8, np.uint64

#: The white space of the contracts is 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=U8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, U8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, U8) if data is not None else np.zeros(0, U8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each holds about `limit` bytes of text; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        offsets = text_bytes(column)[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each maximal run of other bytes than separators, and the n + 1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """An unaligned little-endian load at every byte; bytes past the end read as zero."""
    size = np.dtype(kind).itemsize
    padded = np.zeros(len(data) + size, U8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, kind, padded, strides=(1,))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes on every machine."""
    load = lanes(data)
    out = mix(lengths.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % 2**64))
    at, live = 0, np.arange(len(starts))
    while len(live):
        left = lengths[live] - at
        lane = load[starts[live] + at]
        short = left < 8
        if short.any():
            lane = np.where(short, lane & ((U64(1) << (np.minimum(left, 7) * 8).astype(U64)) - U64(1)), lane)
        value = mix(out[live] ^ lane)
        value += U64(0x9E3779B97F4A7C15)
        out[live] = value
        at += 8
        live = live[left > 8]
    return out


P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """The published XXH64 of each span of bytes, all spans at once."""
    with np.errstate(over="ignore"):
        load8, load4 = lanes(data), lanes(data, "<u4")
        seed64 = U64(seed)
        out = np.full(len(starts), seed64 + P5, U64)
        at = np.zeros(len(starts), np.int64)
        if (big := np.flatnonzero(lengths >= 32)).size:
            v = [np.full(len(big), x, U64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes, begin = lengths[big] // 32, starts[big]
            for s in range(int(stripes.max())):
                live = slice(None) if s < stripes.min() else np.flatnonzero(stripes > s)
                for k in range(4):
                    v[k][live] = _round(v[k][live], load8[begin[live] + 32 * s + 8 * k])
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                h = (h ^ _round(np.zeros(1, U64), v[k])) * P1 + P4
            out[big], at[big] = h, stripes * 32
        out += lengths.astype(U64)
        left = lengths - at
        for _ in range(3):
            if not (live := np.flatnonzero(left >= 8)).size:
                break
            h = out[live] ^ _round(np.zeros(1, U64), load8[starts[live] + at[live]])
            out[live] = _rotl(h, 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
        if (live := np.flatnonzero(left >= 4)).size:
            h = out[live] ^ (load4[starts[live] + at[live]].astype(U64) * P1)
            out[live] = _rotl(h, 23) * P2 + P3
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            if not (live := np.flatnonzero(left > 0)).size:
                break
            h = out[live] ^ (data[starts[live] + at[live]].astype(U64) * P5)
            out[live] = _rotl(h, 11) * P1
            at[live] += 1
            left[live] -= 1
        out = (out ^ (out >> U64(33))) * P2
        out = (out ^ (out >> U64(29))) * P3
        return out ^ (out >> U64(32))


def one_spaced(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words again, each followed by one space, and their new starts."""
    at = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int((lengths + 1).sum()), 0x20, U8)
    source = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + source] = data[np.repeat(starts, lengths) + source]
    return out, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values[offsets[i] : offsets[i + 1]] of every i; zero where that is empty."""
    totals = np.zeros((len(offsets) - 1,) + values.shape[1:], values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if full.size:
        totals[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return totals


class U64Map:
    """Distinct 64-bit keys to their positions, as an open-addressing table: one or two loads a lookup."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=U64)
        self.size = len(keys)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, U64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            done = self.at[slot] == left
            self.keys[slot[done]] = keys[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.mask

    def __getstate__(self) -> tuple[int, bytes]:
        """What is sent to tasks: the keys alone, by byte planes of their differences, compressed."""
        keys = np.zeros(self.size, U64)
        full = self.at >= 0
        keys[self.at[full]] = self.keys[full]
        steps = np.diff(keys, prepend=U64(0))
        return self.size, zlib.compress(np.ascontiguousarray(steps.view(U8).reshape(-1, 8).T).tobytes(), 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        planes = np.frombuffer(zlib.decompress(state[1]), U8).reshape(8, state[0])
        self.__init__(np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        keys = np.ascontiguousarray(keys, dtype=U64)
        slot = self._slots(keys)
        out = self.at[slot]
        live = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & self.mask
            got = self.at[slot]
            out[live] = got
            more = (got >= 0) & (self.keys[slot] != keys[live])
            live, slot = live[more], slot[more]
        return out
