"""Arrow batches of texts as numpy arrays: words, word hashes and word shingles, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that memory does not follow the batch size.
SLICE_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``limit`` bytes in ``column``; a longer row stands alone."""
    for batch in batches:
        offsets = text_buffer(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column; null rows are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _position_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_MULTIPLIER)
    if len(_CACHE.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if n > size:
            return up, down
        _CACHE["up"], _CACHE["down"] = up, down
    return _CACHE["up"][:n], _CACHE["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word and the word offsets of each row; A-Z is lower-cased, ASCII blanks part words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= blank[:-1]
    after = edge[1:].copy()
    after[:-1] |= blank[1:]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    up, down = _position_powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words with their rows; fewer words, but some, count as one run."""
    counts = np.diff(offsets)
    factors = _powers(int(_STEP), size + 1)[1:]
    rows = np.repeat(np.arange(len(counts)), counts)
    width = max(len(hashes) - size + 1, 0)
    whole = np.zeros(width, np.uint64)
    for j in range(size):
        whole += hashes[j : j + width] * factors[j]
    inside = np.arange(width) + size <= offsets[rows[:width] + 1]
    found, owners = [whole[inside]], [rows[:width][inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        value = np.full(len(short), n * int(_MULTIPLIER) % (1 << 64), np.uint64)
        for j in range(n):
            value += hashes[offsets[short] + j] * factors[j]
        found.append(value)
        owners.append(short)
    return mix(np.concatenate(found)), np.concatenate(owners)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, with the rows' offsets."""
    values, rows = shingles(*word_hashes(data, offsets), size)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(len(offsets)))
