"""Vectorised rolling hashes over bytes and words, and fixed-size bitmaps of hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
MOST_BITS = 27  # a bitmap takes at most 2^27 bits, 16 MB, whatever the input
SLICE_BITS = 19


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SIGNS = {seed: mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) for seed in (0, 1)}
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """BASE and INVERSE to the powers 0 to n, modulo 2^64."""
    while len(_powers[0]) <= n:
        m = len(_powers[0])
        for i, b in enumerate((BASE, INVERSE)):
            _powers[i] = np.concatenate((_powers[i], _powers[i] * np.uint64(pow(b, m, 1 << 64))))
    return _powers


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``window`` takes hashes of any stretch."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values))[0][: len(values)], out=out[1:])
    return out


def window(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the stretch lies."""
    return mix((total[end] - total[start]) * _power(len(total))[1][start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    return _SIGNS[seed][buf]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    gap = np.concatenate(([True], _SPACE[buf], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return window(sums(byte_values(buf, seed)), start, end)


def buffers(batches, text: int, most: int = 1 << 20):
    """(rows of a batch, their texts) in runs of about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        at, size = 0, 0
        for i in range(batch.num_rows):
            n = len(batch.column(text)[i].as_buffer())
            if i > at and size + n > most:
                yield batch.slice(at, i - at), [x.as_py() for x in batch.column(text).slice(at, i - at)]
                at, size = i, 0
            size += n
        if batch.num_rows > at:
            yield batch.slice(at), [x.as_py() for x in batch.column(text).slice(at)]


def tidy() -> None:
    """Gives freed memory back at the end of a task; Python workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def bits_for(n: int) -> int:
    """Bits of a bitmap for n hashes: about 16 a hash, between 2^20 and 2^MOST_BITS."""
    return max(20, min(MOST_BITS, int(16 * max(1, n)).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _gather(parts: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of (s int, at binary) rows of places."""
    width = 1 << min(bits, SLICE_BITS)

    def unite(key, batch):
        n = np.zeros(width, bool)
        for x in batch.column(1):
            n[np.frombuffer(x.as_py(), "<u4")] = True
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(n).tobytes()], pa.binary())], ["s", "map"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.groupBy("s").applyInArrow(unite, "s int, map binary").collect():  # 2^bits / 8 bytes in all
        out[r.s * width // 8 : (r.s + 1) * width // 8] = np.frombuffer(r["map"], np.uint8)
    return out


def _sliced(places: np.ndarray, bits: int):
    """Arrow rows (s, at) of places, by slice of the bitmap."""
    width = min(bits, SLICE_BITS)
    places.sort()
    s = places >> width
    cut = np.flatnonzero(np.diff(s)) + 1
    for part in np.split(places, cut) if len(places) else []:
        yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> width)], pa.int32()), pa.array([(part & ((1 << width) - 1)).astype("<u4").tobytes()], pa.binary())], ["s", "at"])


def bitmap_of(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """A bitmap of what ``hashes(batches)`` yields (arrays) over ``df``; a hash sets two places and ``member`` tests both."""

    def run(batches):
        held, size = [], 0
        for h in hashes(batches):
            at = np.concatenate(_places(h, bits))
            held.append(at)
            size += len(at)
            if size > 1 << 22:
                yield from _sliced(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield from _sliced(np.concatenate(held), bits)

    return _gather(df.mapInArrow(run, "s int, at binary"), bits)


def repeated(df: DataFrame, hashes, n: int, hot: int) -> tuple[DataFrame, int]:
    """(h long, often boolean) of the hashes that ``hashes(batches)`` yields twice or more, and how many top bits of a hash h has.

    ``often``: more than ``hot`` times. n, about how many hashes there are, sets the number
    of slices, each about 2^22 of them; 32 bits tell hashes of a slice apart, and those
    that agree in all kept bits count as one. A task adds up what it meets before it sends.
    """
    width = max(8, (n >> 22).bit_length())

    def sliced(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.flatnonzero(np.diff(h >> np.uint64(32))) + 1
        for part, times in zip(np.split(h, cut), np.split(n, cut)):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> np.uint64(32))], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary())], ["s", "at", "times"])

    def run(batches):
        held, size = [], 0
        for h in hashes(batches):
            held.append(h >> np.uint64(32 - width))
            size += len(h)
            if size > 1 << 22:
                yield from sliced(held)
                held, size = [], 0
        if size:
            yield from sliced(held)

    def unite(key, batch):
        at, times = (np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in batch.column(c)]) for c in (1, 2))
        order = np.argsort(at)
        at, times = at[order], times[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total = np.add.reduceat(times, first, dtype=np.int64)
        more = total > 1
        return pa.Table.from_arrays([pa.array((key[0].as_py() << 32) + at[first][more].astype(np.int64)), pa.array(total[more] > hot)], ["h", "often"])

    return df.mapInArrow(run, "s int, at binary, times binary").groupBy("s").applyInArrow(unite, "h long, often boolean"), width + 32


def probed(df: DataFrame, windows, n: int) -> tuple[DataFrame, int]:
    """(h long) of the reference blocks that another window meets, and how many top bits of a hash h has.

    ``windows(batches)`` yields (hashes, which of them are blocks). Blocks and probes are
    dealt by slices of the hash, as in ``repeated``: a slice indexes its blocks and probes
    them with all its windows, a block's own among them. A task sends a hash once.
    """
    width = max(8, (n >> 22).bit_length())

    def sliced(held):
        h, lead = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, lead = h[order], lead[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        state = np.logical_or.reduceat(lead, first).astype(np.uint8) | (np.diff(np.append(first, len(h))) > 1).astype(np.uint8) << np.uint8(1)
        h = h[first]
        cut = np.flatnonzero(np.diff(h >> np.uint64(32))) + 1
        for part, of in zip(np.split(h, cut), np.split(state, cut)):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> np.uint64(32))], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary()), pa.array([of.tobytes()], pa.binary())], ["s", "at", "state"])

    def run(batches):
        held, size = [], 0
        for h, lead in windows(batches):
            held.append((h >> np.uint64(32 - width), lead))
            size += len(h)
            if size > 1 << 22:
                yield from sliced(held)
                held, size = [], 0
        if size:
            yield from sliced(held)
        held = None
        tidy()

    def unite(key, batch):
        at = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)])
        state = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in batch.column(2)])
        index = np.unique(at[state & 1 > 0])
        place = np.searchsorted(index, at)
        hit = np.zeros(len(at), bool)
        inside = place < len(index)
        hit[inside] = index[place[inside]] == at[inside]
        met = np.bincount(place[hit], weights=1 + (state[hit] >> 1), minlength=len(index))
        return pa.Table.from_arrays([pa.array((key[0].as_py() << 32) + index[met > 1].astype(np.int64))], ["h"])

    return df.mapInArrow(run, "s int, at binary, state binary").groupBy("s").applyInArrow(unite, "h long"), width + 32


def column_hashes(batches):
    """Hashes held by the first column."""
    for b in batches:
        yield mix(b.column(0).to_numpy().astype(np.uint64))


def column_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    return bitmap_of(df.select(F.col(column).cast("long")), column_hashes, bits)


def member(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    out = np.ones(len(h), bool)
    for at in _places(h, bits):
        out &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
