"""Byte-level helpers that the training-data operators share.

Texts arrive as Arrow columns.  Their UTF-8 bytes are read in place as NumPy
arrays, in blocks of whole documents, so memory follows the block size (or the
longest document, if that is longer) and never the partition.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D throughout.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: The largest prime below 2**32, and what ``check_hash`` takes modulo it.
PRIME = 4294967291
_ROOT = 2654435769
_REST = np.random.default_rng(20260126).integers(1, PRIME, 256, dtype=np.uint64)
_rests = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def release() -> None:
    """Gives memory that a task no longer needs back to the system, where the C library can: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK):
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers[0]) < n:
        size = -(-n // 65536) * 65536
        for k, b in enumerate((_BASE, _BACK)):
            full = np.full(size, b, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans get equal hashes in every task."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _residues(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of ``check_hash`` and of its inverse modulo ``PRIME``, at least ``n``."""
    if len(_rests[0]) < n:
        for k, b in enumerate((_ROOT, pow(_ROOT, -1, PRIME))):
            full = np.ones(1, np.uint64)
            while len(full) < n:
                full = np.concatenate((full, full * np.uint64(pow(b, len(full), PRIME)) % np.uint64(PRIME)))
            _rests[k] = full
    return _rests[0], _rests[1]


def check_hash(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words (ascending, each inside a row) modulo a prime, spread over 64 bits: what collides in ``span_hash`` does not here."""
    out = np.zeros(len(starts), np.uint64)
    p = np.uint64(PRIME)
    for i, j in blocks(off):
        a, b = np.searchsorted(starts, (off[i], off[j]))
        up, down = _residues(int(off[j] - off[i]) + 1)
        sums = np.zeros(off[j] - off[i] + 1, np.uint64)
        np.cumsum(_REST[data[off[i] : off[j]]] * up[: len(sums) - 1] % p, out=sums[1:])
        s, e = starts[a:b] - off[i], ends[a:b] - off[i]
        out[a:b] = mix((sums[e] - sums[s]) % p * down[s] % p | (e - s).astype(np.uint64) << np.uint64(32))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of a block."""
    solid = ~SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(data))]
    begin[edge] = solid[edge]
    finish[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(off, starts, "right") - 1


def windows(h: np.ndarray, doc: np.ndarray, size: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one row, and where they start."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.ones(n, np.uint64)
    for k in range(size):
        out *= np.uint64(factor)
        out += h[k : k + n]
    return mix(out[at]), at


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``size`` that starts at ``at``."""
    steps = np.bincount(at, minlength=n + 1)[: n + 1].astype(np.int64)
    steps[size:] -= np.bincount(at, minlength=n + 1)[: n + 1 - size] if n + 1 > size else 0
    return np.cumsum(steps[:n]) > 0


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted run of unsigned integers as the byte planes of its gaps, which compress well."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack_sorted(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
