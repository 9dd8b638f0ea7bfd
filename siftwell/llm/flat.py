"""Words of Arrow columns as flat arrays of hashes: no Python object for a word or a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from siftwell.llm.shared import mix

PIECE = 1 << 18
"""Bytes that are hashed at once; a piece ends between words, so a longer word makes a longer piece."""
LONG = 64
"""Words of more bytes are hashed one by one."""
_GOLD = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Bytes:
    """What separates words, and what each byte becomes. Whether a byte stands in a word is a mask of its own: NUL may."""

    def __init__(self, inside: bytes, lower: bool = True):
        """inside: the ASCII bytes of words; all bytes beyond ASCII are in words too. With lower A-Z become a-z."""
        self.inside = np.zeros(256, bool)
        self.inside[list(inside)] = True
        self.inside[128:] = True
        self.value = np.arange(256, dtype=np.uint8)
        if lower:
            self.value[65:91] += 32


_NO_SPACE = bytes(b for b in range(128) if b not in b" \t\n\v\f\r")
SPACED = Bytes(_NO_SPACE)
"""Words are what stands between ASCII white space."""
WHOLE = Bytes(_NO_SPACE, lower=False)
"""As SPACED, with case kept."""
LETTERS = Bytes(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
"""Words are letters and digits of ASCII and all beyond it."""


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the places where each text starts, with the end. Nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return whole, ends - ends[0]


class FlatWords:
    """Hashes words of many texts at once."""

    def __init__(self, bytes_: Bytes):
        self.bytes = bytes_

    def _hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Eight bytes at a time, each step mixed into the last, so that what a byte adds depends on all before it. Words
        of up to seven bytes have hashes of their own: their bytes with their size on top. Longer ones leave no room
        there: their size is mixed in after their first eight bytes."""
        eight = _eights(data)
        first, room = eight[starts] & _MASKS[np.minimum(sizes, 8)], sizes.astype(np.uint64)
        h = mix(np.where(sizes < 8, first | room << np.uint64(56), mix(first) * np.uint64(_GOLD) + room))
        at = np.flatnonzero(sizes > 8)
        for place in range(8, LONG, 8):
            at = at[sizes[at] > place]
            if not len(at):
                break
            h[at] = mix(h[at] * np.uint64(_GOLD) + (eight[starts[at] + place] & _MASKS[np.minimum(sizes[at] - place, 8)]))
        for i in np.flatnonzero(sizes > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
        return h

    def _piece(self, data: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first bytes, sizes) of the words of a piece; breaks: where texts start in it."""
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[breaks] = inside[breaks]
        ends[:-1] &= ~inside[1:]
        last = breaks[breaks > 0] - 1
        ends[last] = inside[last]
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - starts
        return self._hashes(data, starts, sizes), starts, sizes

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all words, where each text's words start, with the end; the bytes; where texts start).

        The bytes and the first byte and size of each word stay in data, at and size until the next call."""
        raw, ends = text_bytes(column)
        data, inside = self.bytes.value[raw], self.bytes.inside[raw]
        n, at, hashes, starts, sizes = len(data), 0, [], [], []
        while at < n:
            to = min(n, at + PIECE)
            while to < n and inside[to]:
                gap = np.flatnonzero(~inside[to : to + PIECE])
                to = to + int(gap[0]) if len(gap) else min(n, to + PIECE)
            breaks = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
            h, s, size = self._piece(data[at:to], inside[at:to], breaks)
            hashes.append(h)
            starts.append(s + at)
            sizes.append(size)
            at = to
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.at, self.size, self.data = where, np.concatenate(sizes) if sizes else where, data
        return flat, np.searchsorted(where, ends), data, ends


    def unlike(self, other: np.ndarray) -> np.ndarray:
        """Which words of the last call differ in their bytes from another one, of the same hash, given by number."""
        out, eight = self.size != self.size[other], _eights(self.data)
        left = np.flatnonzero((self.size > 7) & ~out & (other != np.arange(len(other))))
        for place in range(0, LONG, 8):
            left = left[self.size[left] > place]
            if not len(left):
                break
            mask = _MASKS[np.minimum(self.size[left] - place, 8)]
            out[left] |= (eight[self.at[left] + place] ^ eight[self.at[other[left]] + place]) & mask != 0
        for i in left[self.size[left] > LONG].tolist():
            a, b, n = self.at[i], self.at[other[i]], self.size[i]
            out[i] = not np.array_equal(self.data[a : a + n], self.data[b : b + n])
        return out


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on, as one number."""
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words of a flat array; those that reach over a text's end are the caller's to drop."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(_GOLD) + hashes[i : n + i])
    return out


def within(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): where runs of k words start that stay in their text, and how many each text has."""
    sizes = np.diff(ends)
    counts = np.maximum(sizes - k + 1, 0)
    last = np.cumsum(counts)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(ends[:-1] - (last - counts), counts), counts


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list a text."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
