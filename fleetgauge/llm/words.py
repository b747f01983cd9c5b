"""Word hashes of many texts at once: numpy passes over the bytes instead of a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.Generator(np.random.PCG64(7))
#: A random number per byte value; upper and lower case of A-Z share one in LOWER.
PLAIN = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = PLAIN.copy()
LOWER[65:91] = PLAIN[97:123]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2^64 for i below n; kept in the worker for texts of usual size."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        if n > 1 << 22:
            return _powers(n, base)
        _POWERS[base] = _powers(-(-n >> 20) << 20, base)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the number."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def prefix(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of ``values[j] * up[j]`` over j < i, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray = PLAIN,
                stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash of each run of bytes that ``inside`` marks, and the row it is in, in order.

    For each number of ``stems``, also the hash of so many first bytes of the run, all of it if it is shorter.
    """
    marked = np.zeros(len(data) + 2, np.int8)
    marked[1:-1] = inside[data]
    step = np.diff(marked)
    starts = step[: len(data)] == 1
    # a run that goes over the end of a row is cut there
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] |= marked[1:-1][edge] == 1
    stops = step[1:] == -1
    before = edge - 1
    stops[before] |= marked[1:-1][before] == 1
    a, b = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = powers(len(data) + 1)
    sums = prefix(values[data], up)
    first, scale = sums[a], down[a]
    ends = [b, *(np.minimum(b, a + k) for k in stems)]
    hashes = [mix((sums[e] - first) * scale + (e - a).astype(np.uint64)) for e in ends]
    return hashes[0], np.searchsorted(offsets, a, side="right") - 1, *hashes[1:]
