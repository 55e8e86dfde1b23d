"""Word hashes of whole columns of text at once, on the bytes of Arrow buffers.

A word of up to LANES * 8 bytes is read as 8-byte numbers, which are mixed one after the other on top of its length: a bijection for words of up to 8
bytes, so those can't collide with words of their length. Longer words, which are rare, get 64 bits of BLAKE2b. Nothing but the bytes
and the key decide, so all workers and reruns agree. Whoever knows the key can craft texts that collide; pass one of your own for hostile texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LANES = 4
_FIRST = np.array([(1 << 8 * r) - 1 for r in range(9)], dtype=np.uint64)

#: Bytes of texts handled at once (more where one text is longer).
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += np.uint8(32)

#: Anything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: ASCII letters and digits, and all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows, the nulls as empty texts; offsets are one more than rows."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        stop = min(stop, n)
        yield at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def _seeded(length: np.ndarray, key: int) -> np.ndarray:
    return mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, prefixes: tuple[int, ...] = (), key: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, start, end, row) of each word of a chunk, in order; A-Z count as a-z.

    With prefixes (of up to 8 bytes), also (hash, row) of the beginnings of those lengths in bytes, of the words that are longer.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = kind[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] |= inside[cuts + 1]  # a text begins here
    ends[cuts - 1] |= inside[cuts]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    low = np.zeros(n + 8, dtype=np.uint8)
    low[:n] = LOWER[data]
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # the 8 bytes from each place on
    length = end - start
    h = mix(_seeded(length, key) ^ (eight[start] & _FIRST[np.minimum(length, 8)]))
    for lane in range(1, LANES):
        some = np.flatnonzero(length > 8 * lane)
        if not len(some):
            break
        x = eight[start[some] + 8 * lane] & _FIRST[np.minimum(length[some] - 8 * lane, 8)]
        h[some] = mix(h[some] * np.uint64(0xD6E8FEB86659FD93) ^ x)
    secret = (key & (2**64 - 1)).to_bytes(8, "little")
    for i in np.flatnonzero(length > 8 * LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    row = np.searchsorted(offsets, start, "right") - 1
    if not prefixes:
        return h, start, end, row
    begins, rows = [], []
    for k in prefixes:
        long = np.flatnonzero(length > k)
        begins.append(mix(_seeded(np.full(len(long), 256 + k), key) ^ (eight[start[long]] & _FIRST[k])))
        rows.append(row[long])
    return h, start, end, row, np.concatenate(begins), np.concatenate(rows)


def distinct_buckets(h: np.ndarray, row: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct buckets of each row; buckets is a power of two."""
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(buckets - 1)))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles; a text of fewer words has its whole sequence as one, an empty text none."""
    n = len(h)
    count = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if rows else np.zeros(0, np.int64)
    if n >= k:
        whole = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        s = np.zeros(len(whole), dtype=np.uint64)
        for j in range(k):
            s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[whole + j])
        at = row[whole]
    else:
        s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        t = np.full(len(short), 0xA5A5A5A5, dtype=np.uint64) + count[short].astype(np.uint64)
        for j in range(k - 1):
            more = j < count[short]
            t = np.where(more, mix(t * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(first[short] + j, n - 1)]), t)
        s, at = np.concatenate((s, t)), np.concatenate((at, short))
    return s, at
