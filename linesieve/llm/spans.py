"""Words of many texts as spans of one byte buffer, hashed together, and arrays kept under such hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space: \\x09-\\x0D and \\x20.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at a time, and bytes under one running sum of hashes.
SLICE = 1 << 20
SUM = 1 << 20
#: Bytes from which a word is hashed apart.
LONG_WORD = 1 << 16

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.empty(0, np.uint64)
_INVERSES = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = n + n // 8
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _POWERS, _INVERSES = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _POWERS, _INVERSES


def texts_of(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows with about `limit` bytes; a longer text stands alone."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, or bytes of `white`; a text's end ends its run."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ink = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= ~ink[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~ink[1:]
    return np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1


_WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]").search


def cuts_at_white(raw: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about `size` bytes that end at white space, or with the text."""
    at = 0
    while at < len(raw):
        cut = _WHITE_BYTE(raw, at + size) if len(raw) - at > size else None
        end = cut.start() if cut else len(raw)
        yield at, end
        at = end


def word_slices(raw: bytes, size: int = 2 * SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists from slices of it."""
    for low, high in cuts_at_white(raw, size):
        yield raw[low:high].split()


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds, in the list of spans, of each text's spans."""
    return np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + SUM, "right")))
        part = data[low:ends[to - 1]]
        powers, inverses = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * powers[:len(part)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64))
        at = to
    return out


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; very long ones don't go through the running sums."""
    out, at = np.empty(len(starts), np.uint64), 0
    for k in [*np.flatnonzero(ends - starts > LONG_WORD).tolist(), len(starts)]:
        out[at:k] = span_hashes(data, starts[at:k], ends[at:k])
        if k < len(starts):
            out[k] = xxhash.xxh64_intdigest(data[starts[k]:ends[k]].tobytes())
        at = k + 1
    return out


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[starts[i]:starts[i] + lengths[i]] one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return values[index]


class HashedArrays:
    """Arrays of ids under 64-bit hashes, all in one flat array; holds a worker's cache of encoded words.

    `learn(keys)` gives (ids, counts) for new keys by their index in the list of spans. The cache starts anew when it
    holds `limit` keys.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.used = 0

    def rows_of(self, hashes: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of `starts` and `counts` for each hash; new ones are learnt from one of their places in `hashes`."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(keys) > self.limit:
            self._clear()
        at = np.searchsorted(self.hashes, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == keys[inside]
        rows = np.empty(len(keys), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts = learn(first[new])
            base = len(self.starts)
            rows[new] = np.arange(base, base + len(new))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            self.flat[self.used:self.used + len(ids)] = ids
            self.starts = np.concatenate((self.starts, self.used + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.used += len(ids)
            self.hashes = np.insert(self.hashes, at[new], keys[new])
            self.rows = np.insert(self.rows, at[new], rows[new])
        return rows[inverse]
