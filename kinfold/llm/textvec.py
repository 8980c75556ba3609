"""Vectorised text primitives over Arrow string columns.

Texts are read as the UTF-8 bytes that Arrow already holds, so no Python
string is made per row. Every function works on whole texts; callers walk a
batch in slices of bounded byte size (`slices`) to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte value.
BYTE_KEYS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range by itself."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the maximal runs of one non-zero kind; a run never spans two texts."""
    if len(kind) == 0:
        return np.zeros(0, np.int64)
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    at = offsets[:-1]
    new[at[at < len(kind)]] = True
    new &= kind != 0
    return np.flatnonzero(new)


def run_hashes(data: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the kept bytes from each start to the next."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    values = np.where(keep, BYTE_KEYS[data], U64(0))
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, lengths)
    powers = np.ones(max(int(lengths.max()), int(starts[0]) + 1) + 1, np.uint64)
    powers[1:] = BASE
    np.multiply.accumulate(powers, out=powers)
    return mix(np.add.reduceat(values * powers[place], starts))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space separated word with A-Z lowered, and each text's word offsets (n + 1)."""
    low = LOWER[data]
    keep = ~WHITE[data]
    starts = runs(keep.astype(np.int8), offsets)
    return run_hashes(low, keep, starts), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct `size`-word shingle hashes, concatenated, and their offsets (n + 1).

    A text with 1 to size - 1 words has its whole sequence as the one shingle; a text without words has none.
    """
    w, at = words(data, offsets)
    n = len(at) - 1
    count = np.diff(at)
    out_owner, out_hash = [], []
    if len(w) >= size:
        h = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            h = mix(h * BASE + w[k : len(w) - size + 1 + k] + U64(k + 1))
        owner = np.repeat(np.arange(n), count)
        whole = owner[: len(h)] == owner[size - 1 :]
        out_owner.append(owner[: len(h)][whole])
        out_hash.append(h[whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        h = np.array([mix(np.bitwise_xor.reduce(mix(w[at[i] : at[i + 1]] + np.arange(1, count[i] + 1, dtype=np.uint64) * BASE)) + np.array([count[i]], np.uint64))[0] for i in short], np.uint64)
        out_owner.append(short)
        out_hash.append(h)
    if not out_hash:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    owner, h = np.concatenate(out_owner), np.concatenate(out_hash)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return h, np.searchsorted(owner, np.arange(n + 1))
