"""Removal of long repeated byte strings, by sparse enhanced suffix arrays.

Every string of `length` bytes holds an anchor: the place of the least hash of K bytes in it. Equal strings hold equal
anchors at equal places, so a repeated string is found among occurrences of one anchor, compared left and right of it.

Occurrences whose whole surroundings are equal need no comparison: each is covered, and one stands for all. The rest of an
anchor's occurrences are sorted by what follows the anchor, which is a suffix array of those suffixes. A stack scan over
its common prefixes walks the interval tree from the deepest interval up. When two intervals meet, the members that become
neighbours in the order of what precedes the anchor differ to the left in the least way, and give the maximal repeat they
are in: so many bytes to the left, so many to the right. All occurrences get their spans, not just neighbours in the array.

An anchor with more occurrences than one task should hold is split: the strings of `length` bytes around it are divided by
where they start, each part is keyed by the bytes that all its strings share, and the parts are treated as anchors. After a
few divisions a part is one string, where counting decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import drop, map_text, mix, quoted, store, text_keys

LENGTH = 400
K = 32
GROUP = 200
"""Most occurrences of an anchor that one task compares; larger groups are divided further, with the same result."""
SPLIT = 4
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each w neighbours of x: running values forwards and backwards in blocks of w, then one of each."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Finds anchors in texts: their places and 64-bit hashes."""

    def __init__(self, length: int, k: int):
        self.k, self.w = k, length - k + 1
        self.length = length
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(size, inverse, np.uint64)]), dtype=np.uint64)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, k, w = len(raw), self.k, self.w
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * self.up[:n], dtype=np.uint64)])
        h = mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        least = _sliding(h, w, np.minimum, 2**64 - 1)
        # h is an anchor if it is the least of a window that holds it: if it equals the greatest of those windows' least.
        around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        at = np.flatnonzero(h == _sliding(around, w, np.maximum, 0))
        return at, h[at]


def _same(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence, (bytes to the left, bytes to the right) of its maximal repeats of at least length bytes.

    rights are sorted; lefts are read away from the anchor. Spans that lie within one already known are left out.
    """
    n = len(rights)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r

    def meet(i: int, j: int, depth: int) -> None:
        left = _same(lefts[i], lefts[j])
        if left + depth >= length:
            for x in (i, j):
                if not any(a >= left and b >= depth for a, b in out[x][-2:]):
                    out[x].append((left, depth))

    def merge(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            at = bisect_left(a, r)
            if at:
                meet(order[r], order[a[at - 1]], depth)
            if at < len(a):
                meet(order[r], order[a[at]], depth)
            a.insert(at, r)
        return a

    depths: list[int] = []
    sets = [[rank[0]]]
    for i in range(1, n + 1):
        h = _same(rights[i - 1], rights[i]) if i < n else -1
        while depths and depths[-1] > h:
            top = sets.pop()
            sets[-1] = merge(sets[-1], top, depths.pop())
        if i < n:
            depths.append(h)
            sets.append([rank[i]])
    return out


def _finish(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): spans of occurrences that share a key. Each key's rows come together and sorted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def spans(group: list[tuple]) -> list[tuple]:
            group = list({(r[1], r[2], r[3]): r for r in group}.values())
            if len(group) < 2:
                return []
            found = maximal_repeats([r[4] for r in group], [r[5] for r in group], length)
            return [(r[1], r[2], r[3] - a, r[3] + b) for r, f in zip(group, found, strict=True) for a, b in f]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k1", "k2", "lo", "hi"])

        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != key:
                    out += spans(held)
                    key, held = r[0], []
                held.append(r)
            yield batch(out)
        yield batch(spans(held))

    dealt = rows.select("key", "k1", "k2", "pos", "left", "right").repartition("key").sortWithinPartitions("key", "right", "k1", "k2", "pos")
    return dealt.mapInArrow(run, "k1 long, k2 long, lo int, hi int")


def _split(rows: DataFrame, width: int, part: int, length: int) -> DataFrame:
    """Occurrences divided by where strings start before the anchor: (key, whole, k1, k2, pos, left, right, lo, hi).

    key: the bytes all strings of a part share; whole: the bytes they reach over; both are cut at the text's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, pos, left, right, first in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "pos", "left", "right", "first")), strict=True):
                for s0 in range(first, first + width, part):
                    s1 = min(s0 + part, first + width) - 1
                    low, high = max(s0, length - len(right)), min(s1, len(left))
                    if low > high:
                        continue
                    mark = s0.to_bytes(4, "little")
                    key = xxhash.xxh3_128_digest(mark + left[:s0][::-1] + b"|" + right[: length - s1])
                    whole = xxhash.xxh3_128_digest(mark + high.to_bytes(4, "little") + left[:high][::-1] + b"|" + right[: length - low])
                    out.append((key, whole, k1, k2, pos, left[:high], right[: length - low], s0))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "whole", "k1", "k2", "pos", "left", "right", "first"])

    return rows.mapInArrow(run, "key binary, whole binary, k1 long, k2 long, pos int, left binary, right binary, first int")


def _packed_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and blob, the text's bytes compressed: texts move twice, and move small."""

    def start():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda texts: [[pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]]

    return map_text(docs, keep, {"blob": "binary"}, start)


def repeat_spans(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """(k1, k2, lo, hi) for distinct texts: spans, possibly overlapping, of repeats of at least length bytes. hi may lie
    beyond the text's end.

    Texts that occur twice as a whole are left to the caller; they take part here once.
    """
    k1, k2 = text_keys(F.col("text"))
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    before, after = length - k, length

    def start():
        find = Anchors(length, k)

        def one(text: str | None) -> tuple:
            raw = (text or "").encode("utf-8", "surrogatepass")
            at, h = find(raw)
            around = [xxhash.xxh3_64_intdigest(min(p, before).to_bytes(4, "little") + raw[max(0, p - before) : p + after]) for p in at.tolist()]
            return at.astype(np.int32), h.view(np.int64), np.array(around, np.uint64).view(np.int64)

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    # Anchors: text, place, the anchor's hash h and the hash w of all that surrounds it. Of most, h occurs once: they go.
    fields = {"at": "array<int>", "h": "array<long>", "w": "array<long>"}
    each = F.explode(F.arrays_zip("at", "h", "w")).alias("a")
    made = map_text(keyed, ["k1", "k2"], fields, start).select("k1", "k2", each)
    every = store(made.select("k1", "k2", F.col("a.at").alias("pos"), F.col("a.h").alias("h"), F.col("a.w").alias("w")))
    # Counts are stored before they are joined: then both sides of the join are plain exchanges, and a common h is split.
    common = store(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    anchors = store(every.join(common, "h", "left_semi"))
    drop(every, common)

    # One place stands for all with equal surroundings: the one whose own hash is least. Two places have two hashes.
    place = F.xxhash64("k1", "k2", "pos")
    wholes = store(anchors.groupBy("h", "w").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    several = store(wholes.groupBy("h").agg(F.count("*").alias("members")))
    joined = store(anchors.join(wholes.join(several, "h"), ["h", "w"]).where("first <> last OR members > 1").select("k1", "k2", "pos", "h", (F.col("first") != F.col("last")).alias("twice"), (place == F.col("first")).alias("chief"), "members"))
    drop(anchors, wholes, several)
    covered = joined.where("twice").select("k1", "k2", F.greatest(F.lit(0), F.col("pos") - before).alias("lo"), (F.col("pos") + after).alias("hi"))
    spans = [store(covered.distinct())]

    # With the bytes around it, where an anchor's surroundings differ.
    wanted = joined.where("chief AND members > 1").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "h", "members")).alias("wanted"))
    reps = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    wanted = wanted.join(reps, ["k1", "k2"]).withColumnsRenamed({"k1": "w1", "k2": "w2"})
    blobs = _packed_texts(keyed, ["doc_id", "k1", "k2"])
    on = blobs["doc_id"].eqNullSafe(wanted["id"]) & (blobs["k1"] == wanted["w1"]) & (blobs["k2"] == wanted["w2"])
    rows = store(_cut(blobs.join(wanted, on).select("k1", "k2", "blob", "wanted"), before, after))
    drop(joined)

    width = before + 1
    spans.append(store(_finish(rows.where(F.col("members") <= group), length)))
    large = rows.where(F.col("members") > group).withColumn("first", F.lit(0))
    place = F.struct("k1", "k2", "pos")
    while width > 1 and large.limit(1).count():
        part = -(-width // SPLIT)
        parts = store(_split(large, width, part, length))
        drop(rows)
        reach = parts.groupBy("key", "whole").agg(F.min(place).alias("least"), F.max(place).alias("most"))
        reach = store(reach.select("key", "whole", F.col("least.*"), (F.col("least") != F.col("most")).alias("twice")))
        twice = parts.select("whole", "k1", "k2", (F.col("pos") - F.length("left")).alias("lo"), (F.col("pos") + F.length("right")).alias("hi"))
        spans.append(store(twice.join(reach.where("twice").select("whole"), "whole", "left_semi").select("k1", "k2", "lo", "hi")))
        several = reach.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        one = parts.join(reach.join(several, "key").select("key", "whole", "k1", "k2", "pos", "members"), ["key", "whole", "k1", "k2", "pos"])
        rows = store(one)
        drop(parts, reach)
        width = part
        if width > 1:
            spans.append(store(_finish(rows.where(F.col("members") <= group), length)))
        large = rows.where(F.col("members") > group)
    drop(rows)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def _cut(rows: DataFrame, before: int, after: int) -> DataFrame:
    """(key, k1, k2, pos, members, left, right): the bytes around the wanted places; left is read away from the anchor."""
    names = ["key", "k1", "k2", "pos", "members", "left", "right"]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 100):
                out = []
                for k1, k2, blob, wanted in zip(*(c.to_pylist() for c in b.slice(at, 100).columns), strict=True):
                    raw = unpack(blob)
                    for w in wanted:
                        p = w["pos"]
                        out.append((w["h"].to_bytes(8, "big", signed=True), k1, k2, p, w["members"], raw[max(0, p - before) : p][::-1], raw[p : p + after]))
                cols = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "key binary, k1 long, k2 long, pos int, members long, left binary, right binary")


def remove_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, group: int = GROUP, k: int = K) -> DataFrame:
    """The kept columns with n_bytes, starts and ends (array<int>: maximal removed runs) and kept (binary: what remains).

    A byte goes if a string of length bytes that covers it also starts elsewhere, in its text or another, judged on the
    input. Matches never cross texts. A text that occurs twice and has length bytes goes whole. Null counts as empty; short
    texts stay. Repeated rows each come back, as copies of one another. A null doc_id is no obstacle, extra columns are
    ignored unless kept, an empty table gives an empty one.
    """
    k1, k2 = text_keys(F.col("text"))
    found = repeat_spans(docs, length, k, group).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    copies = docs.select(k1.alias("k1"), k2.alias("k2")).groupBy("k1", "k2").agg(F.count("*").alias("_copies")).where("_copies > 1")
    known = found.join(copies, ["k1", "k2"], "full").withColumnsRenamed({"k1": "_f1", "k2": "_f2"})
    fields = {"n_bytes": "int", "starts": "array<int>", "ends": "array<int>", "kept": "binary"}
    # Kept columns go by place: whatever they are called, no name can clash.
    keep = [c for c in keep if c.lower() not in fields]
    held = [f"col_{i}" for i in range(len(keep))]
    blobs = _packed_texts(docs.select(*(quoted(c).alias(h) for c, h in zip(keep, held, strict=True)), "text", k1.alias("_k1"), k2.alias("_k2")), [*held, "_k1", "_k2"])
    joined = blobs.join(known, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left")
    listed = joined.select(*held, F.struct("blob", "_spans", F.col("_copies").isNotNull().alias("copied")).alias("_row"))

    def start():
        unpack = zstandard.ZstdDecompressor().decompress

        def one(row: dict) -> tuple:
            raw = unpack(row["blob"])
            if row["copied"]:
                pairs = [(0, len(raw))] if len(raw) >= length else []
            else:
                pairs = sorted((x["lo"], min(x["hi"], len(raw))) for x in row["_spans"] or [])
            runs: list[list[int]] = []
            for a, b in pairs:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            ends = [0, *(x for r in runs for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            return len(raw), [r[0] for r in runs], [r[1] for r in runs], kept

        return lambda rows: [list(x) for x in zip(*map(one, rows), strict=True)]

    return map_text(listed, held, fields, start, text="_row").toDF(*keep, *fields)
