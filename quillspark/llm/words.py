"""Words of many texts at once, in numpy, over Arrow's own buffers.

A block is a run of rows; its words (runs of bytes outside ``[\\x20\\x09-\\x0D]``) get an identity of three numbers, with no
Python object per word: two words have the same only if they are equal, or both longer than 16 bytes and of one 128-bit
digest. A 64-bit hash is mixed from the identity. ``Store`` keeps what was computed for a distinct word, looks words up
by hash and compares identities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1_000_000
#: Bytes that part words: fixed values.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For 0..8 bytes, the mask that keeps as many of a little-endian number of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Block:
    """Rows lo..hi of a column of texts: bytes, where each text starts, and its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.data, self.offsets = data, offsets

    def words(self, fold: np.ndarray | None = None) -> None:
        """Finds starts, ends, hashes and, per text, the number of the first word (``first``)."""
        data = self.data if fold is None else fold[self.data]
        n = len(data)
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = space[:-1], space[1:]
            before |= edge[:n]
            after |= edge[1:]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.sizes = self.ends - self.starts
        self.low, self.high = self._identity(data)
        with np.errstate(over="ignore"):
            h = mix(self.low + self.sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            self.hashes = mix(h ^ (self.high * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9)))
        self.first = np.searchsorted(self.starts, self.offsets)


    def _identity(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers a word: its 16 bytes, or the digest of a longer one."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        low = eight[self.starts] & _MASK[np.minimum(self.sizes, 8)]
        high = np.zeros(len(low), np.uint64)
        if len(at := np.flatnonzero(self.sizes > 8)):
            high[at] = eight[self.starts[at] + 8] & _MASK[np.minimum(self.sizes[at] - 8, 8)]
        if len(at := np.flatnonzero(self.sizes > 16)):
            raw = memoryview(np.ascontiguousarray(data))
            digests = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)])
            low[at], high[at] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        return low, high


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A binary column (nulls as empty texts) in blocks of about ``limit`` bytes and whole rows."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start+length-1 of every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Store:
    """What ``make`` gives for each distinct key, by 64-bit hash and identity (three numbers).

    ``make`` gets the position of one occurrence of each new key and returns an array per field for each of them. At
    ``2**bits`` slots (a quarter filled at most) the store is emptied and begins anew: the bound on a worker's memory.
    """

    PROBES = 16

    def __init__(self, dtypes: list[np.dtype], bits: int = 22):
        self.dtypes, self.bits = dtypes, bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.flat = [np.zeros(1 << 16, d) for d in self.dtypes]
        self.used = [0] * len(self.dtypes)
        self.start = [np.zeros(1 << 16, np.int64) for _ in self.dtypes]
        self.length = [np.zeros(1 << 16, np.int64) for _ in self.dtypes]
        self.identity = [np.zeros(1 << 16, np.uint64) for _ in range(3)]

    def _place(self, h: np.ndarray, p: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + p * (2 * p + 1)) & ((1 << self.bits) - 1)

    def _find(self, h: np.ndarray, identity: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for p in range(self.PROBES):
            at = self._place(h[left], p)
            k = self.keys[at]
            slot = self.slots[at]
            hit = k == h[left]
            for own, x in zip(self.identity, identity, strict=True):
                hit &= own[slot] == x[left]
            out[left[hit]] = slot[hit]
            left = left[~hit & (k != 0)]
            if not len(left):
                break
        return out

    def lookup(self, h: np.ndarray, make: Callable[[np.ndarray], list[list[np.ndarray]]], identity: list[np.ndarray] | None = None) -> np.ndarray:
        """The entry of each key; new ones are made. Without identities the hash is one."""
        h = np.where(h == 0, np.uint64(1), h)
        identity = identity or [h, h, h]
        found = self._find(h, identity)
        while len(miss := np.flatnonzero(found < 0)):
            # of keys with one hash that differ, one comes in a turn
            new, at = np.unique(h[miss], return_index=True)
            if self.n and self.n + len(new) > 1 << (self.bits - 2):
                self.clear()
                return self.lookup(h, make, identity)
            at = miss[at]
            self._insert(new, [x[at] for x in identity], make(at))
            found[miss] = self._find(h[miss], [x[miss] for x in identity])
            if (found[at] < 0).any():  # no place left within the probes
                if self.n == len(new):  # more than one block can fill: a larger table
                    self.bits += 2
                self.clear()
                return self.lookup(h, make, identity)
        return found

    def _insert(self, new: np.ndarray, identity: list[np.ndarray], made: list[list[np.ndarray]]) -> None:
        entry = np.arange(self.n, self.n + len(new), dtype=np.int32)
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])
        for f, values in enumerate(made):
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.concatenate(values) if len(values) else np.zeros(0, self.dtypes[f])
            self.flat[f] = grown(self.flat[f], self.used[f] + len(flat))
            self.start[f], self.length[f] = grown(self.start[f], self.n + len(new)), grown(self.length[f], self.n + len(new))
            self.flat[f][self.used[f] : self.used[f] + len(flat)] = flat
            self.start[f][self.n : self.n + len(new)] = self.used[f] + np.cumsum(sizes) - sizes
            self.length[f][self.n : self.n + len(new)] = sizes
            self.used[f] += len(flat)
        self.identity = [grown(x, self.n + len(new)) for x in self.identity]
        for own, x in zip(self.identity, identity, strict=True):
            own[self.n : self.n + len(new)] = x
        self.n += len(new)
        left = np.arange(len(new))
        for p in range(self.PROBES):
            at = self._place(new[left], p)
            _, one = np.unique(at, return_index=True)
            one = one[self.keys[at[one]] == 0]
            self.keys[at[one]], self.slots[at[one]] = new[left[one]], entry[left[one]]
            left = np.delete(left, one)
            if not len(left):
                break

    def gather(self, entries: np.ndarray, field: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The values of the entries one after the other, and how many each has."""
        lengths = self.length[field][entries]
        return self.flat[field][spread(self.start[field][entries], lengths)], lengths
