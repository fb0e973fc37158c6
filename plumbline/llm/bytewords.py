"""Vectorised work on the UTF-8 bytes of a whole Arrow batch.

A batch's texts lie one after another in a byte buffer.  Words and their
64-bit hashes come from a handful of NumPy passes over that buffer, so the
cost is a few nanoseconds a byte and no Python object is made per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The bytes of [\x20\x09-\x0D], the white space of the contracts.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z as a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of 8 bytes with the first n set, n = 0..8 (little-endian).
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG = 64  # bytes; longer runs are hashed one by one


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(col: pa.Array, size: int = 1 << 20):
    """(first row, one past the last, bytes, offsets from 0) of runs of whole texts of about size bytes."""
    data, off = buffers(col)
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each) of the runs of inside, which no text boundary crosses."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    before = np.empty(len(inside), bool)
    after = np.empty(len(inside), bool)
    if len(inside):
        before[0], before[1:] = True, ~inside[:-1]
        after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on as one number; zeros follow the end."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", room, 0, (1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair; equal bytes hash alike anywhere.

    Eight bytes at a time go through the mixer, so that no arrangement of bytes
    cancels out; runs of over LONG bytes take BLAKE2.
    """
    size = ends - starts
    out = size.astype(U64)
    if not len(size):
        return out
    from_here = eights(data)
    todo = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        todo = todo[size[todo] > k]
        if not len(todo):
            break
        part = from_here[starts[todo] + k] & FIRST[np.minimum(size[todo] - k, 8)]
        out[todo] = mix((out[todo] + U64(0x9E3779B97F4A7C15)) ^ mix(part))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def windows(h: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of first word) of the runs of size words that lie in one text."""
    if len(h) < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :])
    out = h[first].copy()
    for k in range(1, size):
        out = mix(out * U64(0xA0761D6478BD642F)) + h[first + k]
    return mix(out), first
