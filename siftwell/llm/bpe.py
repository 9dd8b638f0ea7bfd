"""BPE encoding and decoding with a memory-mapped lexicon of frequent words.

Words are runs between white space. The corpus's frequent words are counted by Spark, merged once, and compiled into a
minimal acyclic automaton whose arcs add up to a word's number; the number leads to its ids. Every task maps the same
file into memory and looks words up in it; words outside it are merged exactly.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.flat import WHOLE, FlatWords, text_bytes
from siftwell.llm.shared import drop, map_text, shared_dir, slabs, store

LEXICON_WORDS = 100_000
"""Most words in the lexicon; all others are merged when met, with the same result."""
MOST_WORDS = 500_000
"""Distinct words that a task remembers before it starts anew."""
LONGEST = 64
"""Bytes of the longest word in the lexicon."""
STEPS = 16
"""Steps per doubling in the histogram of counts from which the lexicon's least count is read."""

# What the tokenizer file's normaliser calls white space.
BLANKS = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
COMMON = regex.compile("[^\\x00-\\u024f]")
SEPARATORS = regex.compile("[\\x1c-\\x1f]")
# Bytes of texts that are not split by ASCII white space and lower-cased alone: from U+0240 on, and separators.
APART = np.zeros(256, bool)
APART[0xC9:] = APART[0x1C:0x20] = True


class Vocabulary:
    """Vocabulary, merges and rules of a tokenizer file: BPE over bytes with a mark at word ends and no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.append(order, len(merges)).astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (chr(256 + i) for i in range(256))
        letters = [chr(b) if b in plain else next(rest) for b in range(256)]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + end] for c in letters], np.int64)
        whole = Tokenizer.from_file(path)
        self.normalise, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _pieces(self, word: str) -> list[bytes]:
        """The pieces of a normalised word that are merged apart from one another, in UTF-8."""
        if COMMON.search(word):
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cut(word)]
        return [word.encode()] if word.isalpha() else [p.encode() for p in self.split.findall(word)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.ranks[-1])

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of non-empty pieces. In each round every piece makes one merge, that of least rank, leftmost first, as if
        each were merged alone; a piece without a merge is done."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        if not pieces:
            return out
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes) - 1
        part = self.inner[raw]
        part[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        none = int(self.ranks[-1])

        def rank(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(part) - 1)
            return np.where((owner[at] == owner[after]) & (after > at), self._rank(part[at], part[after]), none)

        ranks = rank(np.arange(len(part)))
        while len(part):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(part)))
            over = least == none
            if over.any():
                gone = np.repeat(over, sizes)
                ids, who = part[gone].tolist(), owner[starts[over]].tolist()
                to = 0
                for w, n in zip(who, sizes[over].tolist(), strict=True):
                    out[w] = tuple(ids[to : to + n])
                    to += n
                part, owner, ranks = part[~gone], owner[~gone], ranks[~gone]
                least, sizes = least[~over], sizes[~over]
                if not len(part):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            part[hits] = self.merged[ranks[hits]]
            keep = np.ones(len(part), bool)
            keep[hits + 1] = False
            part, owner, ranks = part[keep], owner[keep], ranks[keep]
            hits = hits - np.arange(len(hits))
            ranks[hits] = rank(hits)
            before = np.maximum(hits - 1, 0)
            ranks[before] = rank(before)
        return out

    def ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of normalised words without white space."""
        pieces = [None if w in self.special else self._pieces(w) for w in words]
        known = self.known
        if len(known) > 150_000:
            known.clear()
        new = list({p for ps in pieces if ps for p in ps}.difference(known))
        known.update(zip(new, self.merge(new), strict=True))
        return [(self.special[w],) if ps is None else known[ps[0]] if len(ps) == 1 else tuple(i for p in ps for i in known[p]) for w, ps in zip(words, pieces, strict=True)]

    def words(self, text: str | None) -> list[str]:
        """Normalised words and special tokens of a text, in order."""
        out: list[str] = []
        for part in self.apart.split(text or "") if self.apart and "<" in (text or "") else [text or ""]:
            if part in self.special:
                out.append(part)
            elif COMMON.search(part):
                out += [w for w in BLANKS.split(self.normalise(part)) if w]
            elif SEPARATORS.search(part):
                out += [w for w in BLANKS.split(unicodedata.normalize("NFC", part).lower()) if w]
            else:
                out += part.lower().split()
        return out


class Numbered:
    """Numbers the distinct words that a task meets, and says which one stands at each place of a column of texts.

    Texts of plain letters are hashed whole, and a word is made a string when its hash is met for the first time. The others
    are split one by one.
    """

    def __init__(self, rules: Vocabulary):
        self.rules, self.flat = rules, FlatWords(WHOLE)
        self.clear()

    def clear(self) -> None:
        self.words: list[str] = []
        self.raw: dict[int, bytes] = {}
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.split: dict[str, int] = {}

    @property
    def full(self) -> bool:
        return len(self.words) > MOST_WORDS

    def _apart(self, column: pa.Array) -> np.ndarray:
        """Which texts need more than ASCII white space and lower case."""
        raw, ends = text_bytes(column)
        odd = APART[raw]
        odd[:-1] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
        before = np.concatenate([[0], np.cumsum(odd)])
        apart = before[ends[1:]] > before[ends[:-1]]
        if self.rules.apart:
            before = np.concatenate([[0], np.cumsum(raw == 0x3C)])
            for i in np.flatnonzero(~apart & (before[ends[1:]] > before[ends[:-1]])).tolist():
                apart[i] = bool(self.rules.apart.search(column[i].as_py()))
        return apart

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each place's word, where each text's places start, with the end)."""
        apart = self._apart(column)
        h, ends, kept, _ = self.flat(pc.if_else(pa.array(~apart), column, pa.scalar("", column.type)))
        found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        old = np.append(self.keys, np.uint64(0))[at] == found
        old[at == len(self.keys)] = False
        whole, new = kept.tobytes(), first[~old]
        # A hash stands for the bytes that it was first met with. Texts in which it hides others are split one by one.
        false = self.flat.unlike(first[inverse])
        again = np.flatnonzero(old)
        met = [whole[a : a + n] == self.raw[s] for a, n, s in zip(self.flat.at[first[again]].tolist(), self.flat.size[first[again]].tolist(), np.append(self.slots, 0)[at[again]].tolist(), strict=True)]
        if not all(met):
            false |= np.isin(inverse, again[~np.array(met)])
        if false.any():
            apart[np.searchsorted(ends, np.flatnonzero(false), "right") - 1] = True
        slots = np.append(self.slots, 0)[at]
        slots[~old] = np.arange(len(self.words), len(self.words) + len(new))
        raw = [whole[a : a + n] for a, n in zip(self.flat.at[new].tolist(), self.flat.size[new].tolist(), strict=True)]
        self.raw.update(zip(range(len(self.words), len(self.words) + len(new)), raw, strict=True))
        self.words += [x.decode("utf-8", "replace").lower() for x in raw]
        self.keys, self.slots = np.insert(self.keys, at[~old], found[~old]), np.insert(self.slots, at[~old], slots[~old])
        numbers = slots[inverse]
        if not apart.any():
            return numbers, ends
        parts, sizes = [], np.diff(ends)
        for i in range(len(column)):
            if not apart[i]:
                parts.append(numbers[ends[i] : ends[i + 1]])
                continue
            words = self.rules.words(column[i].as_py())
            for w in words:
                if w not in self.split:
                    self.split[w] = len(self.words)
                    self.words.append(w)
            parts.append(np.fromiter(map(self.split.__getitem__, words), np.int64, len(words)))
            sizes[i] = len(words)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The tokenizer of a file; where an executor keeps the public files elsewhere, the file of that name there."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    return Vocabulary(path)


def compile_lexicon(words: list[tuple[bytes, list[int]]]) -> np.ndarray:
    """The minimal acyclic automaton of sorted words as one array of integers: sizes, arcs, ends of words, ids.

    Suffixes are shared: a state is frozen once no later word can change it, and equal frozen states are one. Each arc
    carries how many words come before those that pass it, so the sum along a path numbers the words.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple[bool, tuple]] = []
    below: list[int] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(key)
            below.append(key[0] + sum(below[t] for _, t in key[1]))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""
    for word, _ in words:
        same = len(os.path.commonprefix([word, last]))
        for i in range(len(last), same, -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], freeze(path.pop())))
    root = freeze(path[0])
    rows = []
    for s, (ends, out) in enumerate(arcs):
        before = int(ends)
        for byte, t in out:
            rows.append((s << 8 | byte, t, before))
            before += below[t]
    rows.sort()
    keys, to, skip = np.array(rows, np.int64).reshape(-1, 3).T
    sizes = np.array([len(i) for _, i in words], np.int64)
    flat = np.array([x for _, i in words for x in i], np.int64)
    head = np.array([len(keys), len(arcs), len(words), len(flat), root], np.int64)
    return np.concatenate([head, keys, to, skip, np.array([e for e, _ in arcs], np.int64), np.concatenate([[0], np.cumsum(sizes)]), flat])


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, data: np.ndarray):
        n_arcs, n_states, n_words, n_ids, self.root = map(int, data[:5])
        ends = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_states, n_words + 1, n_ids])
        self.keys, self.to, self.skip, self.final, self.offsets, self.ids = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1. All words take their steps through the automaton together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(sizes <= LONGEST) if len(self.keys) else np.zeros(0, np.int64)
        for step in range(LONGEST + 1):
            over = live[sizes[live] == step]
            over = over[self.final[state[over]] == 1]
            out[over] = number[over]
            live = live[sizes[live] > step]
            if not len(live):
                break
            key = state[live] << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            live, at = live[good], at[good]
            state[live] = self.to[at]
            number[live] += self.skip[at]
        return out


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Count words over all documents, compile the frequent ones, ship the file to the executors; returns its name."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, n = Numbered(vocabulary(path)), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in numbered.words], pa.binary()), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for part in slabs(batch, 0, 1000):
                places, _ = numbered(part.column(0))
                more = np.bincount(places, minlength=len(numbered.words))
                more[: len(n)] += n
                n = more
                if numbered.full:
                    yield rows()
                    numbered.clear()
                    n = n[:0]
        yield rows()

    counts = docs.select("text").mapInArrow(count, "word binary, n long").where(F.length("word") <= LONGEST)
    counts = store(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    step = F.floor(F.log2("n") * STEPS).alias("step")
    least, room = None, most
    for s, n in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if n > room:
            break
        least, room = s, room - n
    chosen = counts.where(step >= least if least is not None else F.lit(False))
    chosen = chosen.select(F.decode("word", "UTF-8").alias("word"))

    def merge():
        rules = vocabulary(path)
        return lambda words: [[list(i) for i in rules.ids(words)]]

    found = map_text(chosen, ["word"], {"ids": "array<int>"}, merge, text="word").toArrow()
    drop(counts)
    words = sorted((w.encode(), i) for w, i in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(compile_lexicon(words).tobytes()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_decode(docs: DataFrame, path: str, keep: list[str], most: int = LEXICON_WORDS) -> DataFrame:
    """The kept columns with ids (array<int>) and decoded (string) of each whole text.

    Equal to the tokenizers library's encode(text, add_special_tokens=False).ids and decode(ids, skip_special_tokens=False)
    for files of this kind. Special tokens written out in a text become their ids, as there. Null and empty texts give no
    ids and an empty decoded text. Rows stay as they are, repeated ones too; an empty table gives an empty one.
    """
    name = build_lexicon(docs, path, most)

    def start():
        rules = vocabulary(path)
        lexicon, numbered = Lexicon(np.memmap(SparkFiles.get(name), np.int64, "r")), Numbered(rules)
        tokens = pa.array(rules.tokens, pa.string())
        # By word's number: where its ids start and how many there are; in the lexicon, and beyond its end in the tail.
        held = {"starts": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int64), "tail": np.zeros(0, np.int64)}

        def look_up(words: list[str]) -> None:
            at = lexicon.find([w.encode("utf-8", "replace") for w in words])
            at[[i for i, w in enumerate(words) if w in rules.special]] = -1
            unseen, hit = np.flatnonzero(at < 0), at >= 0
            extra = rules.ids([words[i] for i in unseen])
            starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            starts[hit] = lexicon.offsets[at[hit]]
            sizes[hit] = lexicon.offsets[at[hit] + 1] - starts[hit]
            sizes[unseen] = [len(x) for x in extra]
            starts[unseen] = len(lexicon.ids) + len(held["tail"]) + np.cumsum(sizes[unseen]) - sizes[unseen]
            more = {"starts": starts, "sizes": sizes, "tail": np.array([x for ids in extra for x in ids], np.int64)}
            held.update({k: np.concatenate([held[k], x]) for k, x in more.items()})

        def make(column: pa.Array) -> list[pa.Array]:
            if numbered.full:
                numbered.clear()
                held.update({k: x[:0] for k, x in held.items()})
            number, ends = numbered(column)
            look_up(numbered.words[len(held["sizes"]) :])
            starts, tail = held["starts"], held["tail"]
            n = held["sizes"][number]
            last = np.cumsum(n)
            place = np.repeat(starts[number] - last + n, n) + np.arange(last[-1] if len(last) else 0)
            old = place < len(lexicon.ids)
            ids = np.empty(len(place), np.int32)
            ids[old], ids[~old] = lexicon.ids[place[old]], tail[place[~old] - len(lexicon.ids)]
            offsets = pa.array(np.concatenate([[0], last])[ends], pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(ids))
            spoken = pa.ListArray.from_arrays(offsets, tokens.take(listed.values))
            return [listed, pc.binary_join(spoken, " ")]

        return make

    return map_text(docs, keep, {"ids": "array<int>", "decoded": "string"}, start, flat=True, slab=1000)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
