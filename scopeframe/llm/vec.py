"""Vectorised byte and word work on Arrow string columns, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words over so many bytes are hashed one by one.
LONG_WORD = 256

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
PUNCT = WHITE.copy()
PUNCT[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes each; a longer row is a run of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that ``sep`` doesn't mark; runs never cross rows."""
    if not buf.size:
        return (np.zeros(0, np.int64),) * 3
    w = ~sep[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a], last[b] = w[a], w[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def loads(buf: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from it on as one integer, with zeros past the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((buf.size + 1,), np.dtype("<u8"), padded, 0, (1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + M1)
    if not size.size:
        return out
    at = loads(buf)
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while live.size:
        left = size[live] - done
        value = at[starts[live] + done]
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        out[live] = mix((out[live] ^ (value & keep)) * M1)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the runs of ``n`` words; a row with fewer words gives one run of all its words."""
    if not hashes.size:
        return hashes, rows
    count = hashes.size
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[start, count])
    rank = np.arange(count) - np.repeat(start, size)
    left = np.repeat(size, size) - rank
    begin = np.flatnonzero((left >= n) | (rank == 0))
    out = np.zeros(begin.size, np.uint64)
    for j in range(n):
        has = left[begin] > j
        value = np.where(has, hashes[np.minimum(begin + j, count - 1)], np.uint64(0))
        out = mix(out * M1 + value + np.uint64(j + 1))
    return out, rows[begin]


def sets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending in each row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    if h.size:
        new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
        h, r = h[new], r[new]
    return h, r


class Places:
    """Place of each 64-bit key in an array of distinct keys; -1: not there. Direct-mapped tables on different bits, the keys
    that lose a slot in one going to the next."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.bits, self.tables = keys, bits, []
        rest = np.arange(keys.size, dtype=np.int32)
        while rest.size:
            table = np.full(1 << bits, -1, np.int32)
            table[self.slots(keys[rest], len(self.tables))] = rest
            rest = rest[table[self.slots(keys[rest], len(self.tables))] != rest]
            self.tables.append(table)

    def slots(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (((keys + np.uint64(k)) * M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.size, -1, np.int32)
        rest = np.arange(keys.size)
        for k, table in enumerate(self.tables):
            own = keys[rest]
            at = table[self.slots(own, k)]
            good = (at >= 0) & (self.keys[at] == own)
            out[rest[good]] = at[good]
            rest = rest[~good & (at >= 0)]
        return out
