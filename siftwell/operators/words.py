"""Which of many symbols are in each of many lines, word by word.

A text is cut at spaces and line ends without copying it. Only its distinct words meet the automaton, and what holds for a
word is then spread over its places by numpy, so an occurrence is never a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AT_ONCE = 1 << 17
"""Words whose symbols are spread at once: a line may have many, and a word many symbols."""
SLOTS = 1 << 22
"""Places of the table that rejects most pairs of parts before they are looked up."""


@dataclass
class Found:
    """Lines and symbols that they hold, each pair once and in order; of each line its text's row, its number and its bytes."""

    line: np.ndarray
    symbol: np.ndarray
    row: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    text: np.ndarray

    def read(self, line: int) -> str:
        """A line without its end."""
        held = self.text[self.starts[line] : self.starts[line + 1]].tobytes().decode()
        return held.removesuffix("\n").removesuffix("\r")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each i, counts[i] of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _unique(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Words:
    """Distinct symbols, none blank, with a space at an end or with a line end, made ready to be found.

    A symbol without a space lies in one word. Of another one the first part ends a word and the second begins the next; with
    more than two parts, and where a carriage return may stand at a line's end, the line itself is looked at.
    """

    def __init__(self, symbols: list[str]):
        import ahocorasick

        self.symbols, self.n = symbols, len(symbols)
        places: dict[str, int] = {}
        single, pairs = [], []
        for i, s in enumerate(symbols):
            first, *rest = s.split(" ")
            a = places.setdefault(first, len(places))
            if rest:
                pairs.append((a, places.setdefault(rest[0], len(places)), i))
            else:
                single.append((a, i))
        self.m = len(places)
        self.single = np.full(self.m, -1)
        self.first, self.second = np.zeros(self.m, bool), np.zeros(self.m, bool)
        self.sizes = np.array([len(p) for p in places], np.int64)
        for a, i in single:
            self.single[a] = i
        for a, b, _ in pairs:
            self.first[a] = self.second[b] = True
        pairs = sorted((a * self.m + b, i) for a, b, i in pairs)
        self.pair_keys, self.pair_symbols = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.slots = np.zeros(SLOTS, bool)
        self.slots[self.pair_keys % SLOTS] = True
        self.blank = places.get("", -1)
        self.looked_at = np.array([s.count(" ") > 1 or "\r" in s for s in symbols], bool)
        self.automaton = ahocorasick.Automaton()
        for p, i in places.items():
            if p:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def find(self, texts: pa.Array) -> Found:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            none = np.zeros(0, np.int64)
            return Found(none, none, none, none, np.zeros(1, np.int64), data)
        cuts = _unique(np.concatenate([np.flatnonzero((data == 32) | (data == 10)) + 1, offsets]))
        ends, last = cuts[1:], data[cuts[1:] - 1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        ending = (last == 10) | edge[ends]
        line = np.cumsum(ending) - ending
        firsts = np.flatnonzero(np.append(True, ending[:-1]))
        row = np.searchsorted(offsets, cuts[firsts], "right") - 1
        opening = np.append(True, row[1:] != row[:-1])
        number = np.arange(len(row)) - np.flatnonzero(opening)[np.cumsum(opening) - 1] + 1
        # A word keeps the sign that ends it, so the words lie in the text without gaps.
        coded = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside, fronts, backs = self._of_names(pc.utf8_rtrim(coded.dictionary, " \n"))
        # Places whose next word follows after a space.
        follows = np.flatnonzero(((last == 32) & ~edge[ends])[:-1])
        keys = [self._singles(line[a : a + AT_ONCE], code[a : a + AT_ONCE], *inside) for a in range(0, len(code), AT_ONCE)]
        if len(self.pair_keys):
            keys += [self._pairs(line, code, follows[a : a + AT_ONCE], fronts, backs) for a in range(0, len(follows), AT_ONCE)]
        key = _unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        found = Found(key // self.n, key % self.n, row, number, np.append(cuts[firsts], len(data)), data)
        asked = np.flatnonzero(self.looked_at[found.symbol])
        if len(asked):
            wrong = [i for i in asked.tolist() if self.symbols[found.symbol[i]] not in found.read(found.line[i])]
            found.line, found.symbol = np.delete(found.line, wrong), np.delete(found.symbol, wrong)
        return found

    def _of_names(self, names: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """Of distinct words: the symbols inside, the parts that end it, and those that begin it; each as starts, counts, values."""
        n, sizes = len(names), pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        # No part has a line end, so none goes from one word to the next.
        ended = pc.binary_join_element_wise(names, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
        whole = ended.buffers()[2].to_pybytes().decode()
        hits = chain.from_iterable(self.automaton.iter(whole)) if len(self.automaton) else ()
        end, part = np.fromiter(hits, np.int64).reshape(-1, 2).T
        name = np.repeat(np.arange(n), sizes + 1)[end]

        def listed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            counts = np.bincount(at, minlength=n)
            return np.cumsum(counts) - counts, counts, values

        some = self.single[part] >= 0
        key = _unique(name[some] * self.n + self.single[part[some]])
        closing = self.first[part] & (end + 1 == starts[name] + sizes[name])
        opening = self.second[part] & (end + 1 - self.sizes[part] == starts[name])
        at, values = name[opening], part[opening]
        if self.blank >= 0:
            order = np.argsort(np.append(at, np.arange(n)), kind="stable")
            at, values = np.append(at, np.arange(n))[order], np.append(values, np.full(n, self.blank))[order]
        return listed(key // self.n, key % self.n), listed(name[closing], part[closing]), listed(at, values)

    def _singles(self, line: np.ndarray, code: np.ndarray, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
        many = counts[code]
        return _unique(np.repeat(line * self.n, many) + values[_spread(starts[code], many)])

    def _pairs(self, line: np.ndarray, code: np.ndarray, at: np.ndarray, fronts: tuple, backs: tuple) -> np.ndarray:
        a, b = code[at], code[at + 1]
        # First the parts that end the word, then for each those that begin the next.
        many = np.where(backs[1][b] > 0, fronts[1][a], 0)
        front = fronts[2][_spread(fronts[0][a], many)] * self.m
        b, at = np.repeat(b, many), np.repeat(at, many)
        many = backs[1][b]
        pair = np.repeat(front, many) + backs[2][_spread(backs[0][b], many)]
        kept = np.flatnonzero(self.slots[pair % SLOTS])
        pair, at = pair[kept], np.repeat(at, many)[kept]
        low, high = np.searchsorted(self.pair_keys, pair, "left"), np.searchsorted(self.pair_keys, pair, "right")
        return _unique(np.repeat(line[at] * self.n, high - low) + self.pair_symbols[_spread(low, high - low)])
