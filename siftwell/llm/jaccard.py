"""N-gram Jaccard join: documents whose shingle sets are alike, by a grouped prefix join.

Sets with an identical prefix and size form one group. Groups meet on prefix tokens, group pairs are filtered by size and
by position, and what is left is expanded to members and verified on the words themselves.

Only links that can change a component are verified. First each token's most central group is compared to the others of
the token (a star); whatever the stars have joined needs no more comparison, and all remaining pairs of differing labels
are verified. So a group of m near copies costs about m verifications, not m * m, and no link between components is lost.

Tokens are ordered by how common they are, then by hash, so passages that many documents share come late and are seldom in
a prefix. All tokens of all documents are counted; those in at least COMMON rows get a level, the logarithm of their count,
in a table with a fixed number of places that is broadcast. The prefix filter is exact under any order of tokens, so tokens
that share a place cost candidates and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.flat import SPACED, FlatWords, lists, runs, within
from siftwell.llm.shared import drop, map_text, mix, slabs, store, text_keys

BITS = 24
"""2**24 levels of two bytes: 32 MB to broadcast at any input size."""
STEPS = 1024
"""Levels per doubling of a count: tokens of one group of near copies differ little in theirs."""
COMMON = 4
"""Rows that a token is in before it gets a level."""
PACKED = 1 << 21
"""Tokens that a task counts at once."""
LEVELS = 1 << 22
"""Most tokens with a level, the most common ones; 32 MB reach the driver."""
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _flat_sets(words: FlatWords, column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which text each is of, set sizes): the distinct shingles of texts, sorted by text and hash."""
    h, ends, _, _ = words(column)
    sizes = np.diff(ends)
    at, counts = within(ends, k)
    s, of = runs(h, k)[at], np.repeat(np.arange(len(sizes), dtype=np.uint16), counts)
    for j in range(1, k):
        # Fewer than k words: all of them are the one shingle.
        short = np.flatnonzero(sizes == j)
        if len(short):
            g = np.full(len(short), np.uint64(j))
            for i in range(j):
                g = mix(g * GOLD + h[ends[short] + i])
            s, of = np.concatenate([s, g]), np.concatenate([of, short.astype(np.uint16)])
    order = np.argsort(s)
    order = order[np.argsort(of[order], kind="stable")]
    s, of = s[order], of[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[fresh], of[fresh]
    return s, of, np.bincount(of, minlength=len(sizes))


def _first(s: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `most` of each text's shingles, and each one's place in its text."""
    counts = np.minimum(n, most)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return s[place + np.repeat(np.cumsum(n) - n, counts)], place


def _prefix_size(n: np.ndarray, likeness: Fraction) -> np.ndarray:
    return np.where(n > 0, n - -(-n * likeness.numerator // likeness.denominator) + 1, 0)


def _counts(docs: DataFrame, k: int, common: int) -> DataFrame:
    """(token, n): the low half of each token that at least `common` sets hold, and in how many rows it is.

    Tasks count PACKED tokens at a time and send each bucket its values and counts as packed numbers, so a token that all
    documents hold is sent once a pack. The number of buckets follows the input, so one holds about eight packs at any
    size; a task adds up its buckets one by one.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // (40 * PACKED))
    buckets = np.uint64(wanted)
    names = ["bucket", "values", "counts"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = FlatWords(SPACED), [], 0

        def flush() -> pa.RecordBatch:
            s, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            bucket = (s >> np.uint64(32)) % buckets
            order = np.argsort(bucket, kind="stable")
            s, counts, bucket = s[order].astype(np.uint32), counts[order].astype(np.uint32), bucket[order]
            found, at = np.unique(bucket, return_index=True)
            ends = np.append(at, len(s)).tolist()
            cut = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x in (s, counts)]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *(pa.array(c, pa.binary()) for c in cut)], names=names)

        for batch in batches:
            for part in slabs(batch, 0, 1000):
                held.append(_flat_sets(words, part.column(0), k)[0])
                n += len(held[-1])
                if n > PACKED:
                    yield flush()
                    held, n = [], 0
        yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(packs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            v, c = (np.frombuffer(b"".join(x), np.uint32) for x in zip(*packs, strict=True))
            order = np.argsort(v)
            v, c = v[order], c[order].astype(np.int64)
            at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            n = np.add.reduceat(c, at)
            good = n >= common
            return pa.RecordBatch.from_arrays([pa.array(v[at][good].view(np.int32)), pa.array(n[good])], names=["token", "n"])

        now, held = None, []
        for batch in batches:
            for bucket, v, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if bucket != now and held:
                    yield whole(held)
                    held = []
                now = bucket
                held.append((v, c))
        if held:
            yield whole(held)

    packed = docs.select("text").mapInArrow(pack, "bucket long, values binary, counts binary")
    return packed.repartition(min(wanted, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(add, "token int, n long")


def _levels(docs: DataFrame, k: int, bits: int, common: int) -> np.ndarray:
    """The level of each class of tokens: 0, or for common ones the logarithm of the highest count of its tokens."""
    counts = store(_counts(docs, k, common))
    step = F.floor(F.log2("n") * STEPS).cast("int").alias("step")
    least, room = None, LEVELS
    for at, n in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if n > room:
            break
        least, room = at, room - n
    table = np.zeros(1 << bits, np.uint16)
    if least is not None:
        place = F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).alias("place")
        found = counts.where(step >= least).select(place, (step - (least - 1)).alias("level")).groupBy("place").agg(F.max("level").alias("level")).toArrow()
        table[found["place"].to_numpy()] = np.minimum(found["level"].to_numpy(), 65535).astype(np.uint16)
    drop(counts)
    return table


def _prefixes(docs: DataFrame, k: int, likeness: Fraction, bits: int, common: int) -> DataFrame:
    """(doc_id, k1, k2, n, sid, gid, prefix): a document's set size, set id, group id and first tokens. Ids are null without words."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, k, bits, common))
    k1, k2 = text_keys(F.col("text"))
    low = np.uint64((1 << bits) - 1)

    def start():
        words, level = FlatWords(SPACED), levels.value

        def pairs(a: np.ndarray, b: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Two sums of each text's values, with its size, as 16 bytes."""
            sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[ends]) for x in (a, b)]
            return np.stack([mix(x + size) for x in sums], axis=1)

        def ids(x: np.ndarray, some: np.ndarray) -> pa.Array:
            raw = x.tobytes()
            return pa.array([raw[16 * i : 16 * i + 16] if y else None for i, y in enumerate(some.tolist())], pa.binary())

        def make(column: pa.Array) -> list[pa.Array]:
            s, of, n = _flat_sets(words, column, k)
            size, some = n.astype(np.uint64), n > 0
            sid = pairs(mix(s), mix(~s), np.concatenate([[0], np.cumsum(n)]), size)
            # Shingles are sorted by text and hash already: now by text and level, each level by hash.
            s = s[np.argsort(of.astype(np.int64) << 16 | level[(s & low).astype(np.int64)], kind="stable")]
            most = _prefix_size(n, likeness)
            first, place = _first(s, n, most)
            steps = mix(first + (place + 1).astype(np.uint64) * GOLD)
            gid = pairs(steps, mix(~steps), np.concatenate([[0], np.cumsum(most)]), size)
            return [pa.array(n, pa.int64()), ids(sid, some), ids(gid, some), lists(first.view(np.int64), most, pa.int64())]

        return make

    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    return store(map_text(keyed, ["doc_id", "k1", "k2"], {"n": "long", "sid": "binary", "gid": "binary", "prefix": "array<long>"}, start, flat=True, slab=1000))


def _verify(pairs: DataFrame, texts: DataFrame, k: int, likeness: Fraction) -> DataFrame:
    """The pairs (a, b) of set ids whose texts' shingles are alike enough. a may be one hot pivot: its side of the join holds two ids a row."""
    num, den = likeness.numerator, likeness.denominator

    def grams(text: bytes) -> set:
        w = text.lower().split()
        return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sa = None, set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                if ta != last:
                    last, sa = ta, grams(unpack(ta))
                sb = grams(unpack(tb))
                both = len(sa & sb)
                keep.append(both > 0 and den * both >= num * (len(sa) + len(sb) - both))
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("sid").alias("a"), F.col("blob").alias("ta"))
    right = texts.select(F.col("sid").alias("b"), F.col("blob").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(alike, "a binary, b binary")


def _fits(likeness: Fraction, x: str, y: str):
    """Size filter, and position filter at a shared token: what precedes it in either set is not in the other."""
    num, den = likeness.numerator, likeness.denominator
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    most = F.lit(1) + F.least(nx - px - 1, ny - py - 1)
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & ((num + den) * most >= num * (nx + ny))


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, blob) of the sets: the text, compressed, of one of the documents that have the set."""

    def start():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda texts: [[pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]]

    k1, k2 = text_keys(F.col("text"))
    keyed = map_text(docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")), ["doc_id", "k1", "k2"], {"blob": "binary"}, start)
    reps = sets.select("sid", F.col("rep.doc_id").alias("id"), F.col("rep.k1").alias("r1"), F.col("rep.k2").alias("r2"))
    same = keyed["doc_id"].eqNullSafe(reps["id"]) & (keyed["k1"] == reps["r1"]) & (keyed["k2"] == reps["r2"])
    return store(keyed.join(reps, same).select("sid", "blob"))


def jaccard_components(docs: DataFrame, k: int = 5, likeness: Fraction = Fraction(4, 5), bits: int = BITS, common: int = COMMON) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_docs, component, k1, k2) for each row of docs (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when shared / all shingles >= likeness.
    component_id: the smallest doc_id reachable by links; set_docs: rows with exactly the same set. component: a key of the component, null without shingles; k1, k2 key the text.

    Null or empty texts, and texts without a word: no shingles, linked with nothing, component_id is the row's own doc_id.
    Repeated rows each get a row back, with one component. A null doc_id is kept and never becomes a component_id while
    its component has another. Fewer than k words: the sequence is the one shingle. Further columns of docs are ignored.
    An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    base = _prefixes(docs, k, likeness, bits, common)
    full = base.where("n > 0")
    sets = full.groupBy("sid", "gid", "n").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("rep"), F.count("*").alias("docs"), F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"))
    sets = store(sets)
    groups = store(sets.groupBy("gid", "n").agg(F.max_by("sid", F.struct("docs", "sid")).alias("head"), F.count("*").alias("size"), F.sum("docs").alias("docs"), F.first("prefix").alias("prefix")))

    # Groups meet on the tokens of their prefixes. A group of several sets meets itself.
    tokens = groups.select("head", "n", "size", "docs", F.size("prefix").alias("of"), F.posexplode("prefix").alias("pos", "token"))
    met = tokens.groupBy("token").agg(F.count("*").alias("groups"), F.max("size").alias("most")).where("groups > 1 OR most > 1")
    rows = store(tokens.join(met.select("token"), "token").select("token", "head", "n", "pos", "docs", "of"))
    # An original has no token of its own: edits make those. Of equals the one with most copies is in the middle.
    central = rows.groupBy("head").agg(F.struct((F.count("*") - F.max("of")).alias("own"), F.max("docs").alias("docs")).alias("central"))
    ranked = rows.join(central, "head")
    heads = groups.select("gid", "head").join(central.select("head"), "head", "left_semi")
    members = store(sets.join(heads, "gid").select("sid", "head", "rep"))
    texts = _texts(docs, members)

    # The star: each group's head with its members, each token's most central group with the token's other groups.
    within_ = members.where("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    pivots = ranked.groupBy("token").agg(F.max(F.struct("central", "head", "n", "pos")).alias("p")).select("token", "p.*")
    across = rows.alias("x").join(pivots.alias("p"), "token").where((F.col("x.head") != F.col("p.head")) & _fits(likeness, "x", "p"))
    star = store(within_.union(across.select(F.col("p.head").alias("a"), F.col("x.head").alias("b"))).distinct())
    links = store(_verify(star, texts, k, likeness).distinct())
    labels = components(links)

    # The rest: pairs in a token whose labels differ. One of the two lies outside the token's largest class.
    label = F.coalesce("label", "sid").alias("label")
    known = members.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "head", label)
    spread = store(rows.join(known, "head").select("token", "sid", "n", "pos", "label"))
    classes = spread.groupBy("token", "label").agg(F.count("*").alias("m"))
    open_ = classes.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("token", "main")
    live = store(spread.join(open_, "token"))
    drop(spread)
    x, y = live.where("label <> main").alias("x"), live.alias("y")
    differ = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid")))
    rest = x.join(y, "token").where(differ & _fits(likeness, "x", "y"))
    rest = rest.select(F.col("y.sid").alias("a"), F.col("x.sid").alias("b")).distinct()
    seen = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = store(rest.join(seen, ["a", "b"], "left_anti"))
    drop(rows, live)
    if rest.limit(1).count():
        more = store(links.union(_verify(rest, texts, k, likeness)).distinct())
        drop(labels)
        labels = components(more)
        drop(more)
    drop(rest, star, links, texts, groups, members)

    # Only sets that have a link need the join with labels; the others are components of their own.
    known = sets.select("sid", "docs", "least").join(labels, F.col("sid") == F.col("node"), "left").select("sid", "docs", "least", F.coalesce("label", "sid").alias("label"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    ends = known.join(least, "label").select("sid", F.col("docs").alias("set_docs"), "component_id", F.col("label").alias("component"))
    out = base.where("n > 0").select("doc_id", "n", "sid", "k1", "k2").join(ends, "sid", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "set_docs", "component", "k1", "k2")
    # Documents without words are linked with nothing: they pass by the joins.
    bare = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("set_docs"), F.lit(None).cast("binary").alias("component"), "k1", "k2")
    return out.unionByName(bare)
