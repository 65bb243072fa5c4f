"""Whole-batch text primitives on UTF-8 buffers: words, rolling hashes, shingles.

Everything here works on one flat ``uint8`` buffer that holds many documents one
after the other plus an ``int64`` offset vector, the layout Arrow already has, so
no Python object is made per word.  Hashes are 64 bit and depend only on the
bytes hashed, never on the machine, the partition or the process.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word separators of every contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
IS_WORD = np.ones(256, np.bool_)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes worked on at once; the tables of powers that a worker keeps are as long.
SLAB = (1 << 19) - 64
_BASE, _WBASE = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls up to 2**20 entries."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            both.append(p)
        have = tuple(both)
        if size <= 1 << 20:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and so would what its allocators keep."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def each(batches):
    """The batches; after each one what it took is given back."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slabs(off: np.ndarray, most: int = SLAB):
    """Runs [a, b) of whole documents with at most `most` bytes, or one longer document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(buf: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (n + 1 entries).

    `cut` marks bytes at which a word is to start although another one ends there.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = IS_WORD[buf]
    edge = np.zeros(n + 1, np.bool_)
    edge[off] = True
    if cut is not None:
        edge[:n] |= cut
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    n = len(buf)
    p, inv = powers(_BASE, n + 1)
    s = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[buf] * p[:n], out=s[1:])
    h = (s[ends] - s[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def rolling(values: np.ndarray, length: int, base: int = _WBASE) -> np.ndarray:
    """Hash of values[i : i + length] for each i at which that many are left."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, inv = powers(base, len(values) + 1)
    s = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], out=s[1:])
    return mix((s[length:] - s[:n]) * inv[:n] + U64(length))


def window_starts(woff: np.ndarray, length: int) -> np.ndarray:
    """Which positions of the flat word vector start a window of `length` words inside one document."""
    n = int(woff[-1])
    ok = np.ones(n, np.bool_)
    for d in range(length - 1):
        at = woff[1:] - 1 - d
        ok[at[at >= woff[:-1]]] = False
    return ok


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each document's first word."""
    out, counts = [], [np.zeros(1, np.int64)]
    for a, b in slabs(off):
        part = buf[off[a] : off[b]]
        part = LOWER[part] if lower else part
        s, e, w = words(part, off[a : b + 1] - off[a])
        out.append(spans_hash(part, s, e))
        counts.append(np.diff(w))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(np.concatenate(counts))
