"""Near-duplicate removal by bottom-k sketches of one hash function.

A document's sketch is the RETAINED smallest hashes of its shingles. Runs of neighbouring retained values form inverted
lists, and two documents become candidates where their lists overlap. A pair's union sketch, the smallest values of both
together, is a sample without replacement of the union of their sets, so the part of it that both retain estimates their
likeness: pairs whose estimate is too small for linked ones are dropped, all others are verified on their full sets.

How long a run may be, how many runs linked sketches share and how small an estimate may be follow from MISS: of pairs at
exactly the least likeness that links, at most that part falls below each. Small sets are retained whole; there the number
of runs follows from how many values may differ, and nothing is lost.

A run is seldom common by chance, as a single value (a frequent word pair) is. Each sketch enters only its rarest lists, all
but as many as linked ones share; a sketch that meets others in fewer lists than that enters none. Lists are not compared all
with all: each list's most central set meets the others, so a group of m near copies costs about m pairs. What that leaves
open, links between sets of differing components, is found among the sets that entered lists by the shingles themselves: a
linked pair shares one of the rarest of both, at places and with sizes that still allow the likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.flat import SPACED, FlatWords, lists
from siftwell.llm.jaccard import _first, _flat_sets, _texts, _verify
from siftwell.llm.shared import drop, map_text, mix, store, text_keys

RETAINED = 48
"""Values of a sketch."""
MISS = 1e-6
"""Part of the pairs at exactly the least likeness that a sketch may rule out."""
_SIGN = np.uint64(1 << 63)


def least_overlap(retained: int, likeness: Fraction, miss: float = MISS) -> int:
    """The most values that all but `miss` of the linked pairs share in their union sketch. Draws are without replacement,
    so the binomial tail is the worst case."""
    below = 0.0
    for x in range(retained + 1):
        below += comb(retained, x) * float(likeness) ** x * float(1 - likeness) ** (retained - x)
        if below > miss:
            return max(1, x)
    return retained


def differing(n: int, likeness: Fraction) -> int:
    """The most values of a union of n that only one of two linked sets has."""
    return n - -(-n * likeness.numerator // likeness.denominator)


def shared_runs(n: int, run: int, likeness: Fraction) -> int:
    """The fewest runs of neighbours that two linked sets have in common whose union of n values is known whole: each value
    that only one has ends a run of common ones."""
    d = differing(n, likeness)
    return n - d - (run - 1) * (d + 1)


def run_size(retained: int, likeness: Fraction) -> int:
    """Two, if that many neighbours are always common to linked sets that are not equal, else one."""
    return 2 if all(differing(n, likeness) == 0 or shared_runs(n, 2, likeness) > 0 for n in range(2, retained + 1)) else 1


def least_runs(retained: int, run: int, likeness: Fraction, miss: float = MISS) -> int:
    """The most runs that all but `miss` of the linked pairs share in their union sketch."""
    p = float(likeness)
    # By the length of the run of common values so far (run: that or longer) and the runs counted.
    odds = np.zeros((run + 1, retained + 2))
    odds[0, 0] = 1
    for _ in range(retained):
        after = np.zeros_like(odds)
        after[0] = (1 - p) * odds.sum(axis=0)
        for size in range(run + 1):
            if size + 1 >= run:
                after[run, 1:] += p * odds[size, :-1]
            else:
                after[size + 1] += p * odds[size]
        odds = after
    return max(1, int(np.searchsorted(np.cumsum(odds.sum(axis=0)), miss, "right")))


def sketches(docs: DataFrame, k: int, retained: int) -> DataFrame:
    """(doc_id, k1, k2, n, sid, sketch): set size, id of the set and its smallest hashes in order. sid is null without words."""
    k1, k2 = text_keys(F.col("text"))

    def start():
        words = FlatWords(SPACED)

        def make(column: pa.Array) -> list[pa.Array]:
            s, _, n = _flat_sets(words, column, k)
            ends = np.concatenate([[0], np.cumsum(n)])
            sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)])[ends]) for x in (s, ~s)]
            raw = np.stack([mix(x + n.astype(np.uint64)) for x in sums], axis=1).tobytes()
            sid = pa.array([raw[16 * i : 16 * i + 16] if size else None for i, size in enumerate(n.tolist())], pa.binary())
            most = np.minimum(n, retained)
            # With the top bit turned, numbers with a sign have the order of those without.
            low = (_first(s, n, most)[0] ^ _SIGN).view(np.int64)
            return [pa.array(n, pa.int64()), sid, lists(low, most, pa.int64())]

        return make

    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    return store(map_text(keyed, ["doc_id", "k1", "k2"], {"n": "long", "sid": "binary", "sketch": "array<long>"}, start, flat=True, slab=1000))


def need(n: Column, retained: int, likeness: Fraction, run: int, miss: float) -> Column:
    """Runs that a sketch shares with each linked one. The union of a set that is small enough is retained whole."""
    whole = F.array(*(F.lit(max(1, shared_runs(i, run, likeness))) for i in range(retained + 1)))
    exact = F.get(whole, F.least(n, F.lit(retained)).cast("int"))
    return F.when(n * likeness.denominator <= retained * likeness.numerator, exact).otherwise(F.lit(least_runs(retained, run, likeness, miss))).cast("int")


def inverted_lists(sets: DataFrame, retained: int, likeness: Fraction, miss: float = MISS) -> DataFrame:
    """(key, num, n, weight): the lists that each set enters, those of its rarest runs of retained values. weight: how often the
    set meets others in all of its lists."""
    run = run_size(retained, likeness)
    at = F.sequence(F.lit(1), F.size("sketch") - (run - 1))
    keys = F.transform(at, lambda i: F.xxhash64(*(F.element_at("sketch", i + j) for j in range(run))))
    each = sets.where(F.size("sketch") >= run).select("num", F.col("n").cast("int").alias("n"), F.explode(keys).alias("key"))
    # A run of one set links nothing.
    counts = store(each.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"))
    met = each.join(counts, "key").groupBy("num", "n").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("keys"))
    shared, wanted = F.size("keys"), need(F.col("n"), retained, likeness, run, miss)
    first = F.slice("keys", 1, F.col("shared") - F.col("wanted") + 1)
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda w, k: w + k["held"]).alias("weight")
    kept = met.withColumns({"shared": shared, "wanted": wanted}).where("shared >= wanted").select("num", "n", weight, F.explode(first).alias("k"))
    out = store(kept.select("k.key", "num", "n", "weight"))
    drop(counts)
    return out


def _bin(n: Column) -> Column:
    """Sizes that differ by about two percent are in one class."""
    return F.floor(F.log(n.cast("double")) / 0.02).cast("int")


def shingled(texts: DataFrame, k: int) -> DataFrame:
    """(sid, tokens): the distinct shingles of texts (sid, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = FlatWords(SPACED), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                column = pa.array([unpack(x).decode("utf-8", "replace") for x in part.column(1).to_pylist()], pa.string())
                s, _, n = _flat_sets(words, column, k)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(s.view(np.int64), n, pa.int64())], names=["sid", "tokens"])

    return texts.select("sid", "blob").mapInArrow(run, "sid binary, tokens array<long>")


def open_pairs(sets: DataFrame, likeness: Fraction) -> DataFrame:
    """(a, b): pairs of sets (num, n, label, tokens) with differing labels that may be linked; none of those that are is left out.

    Tokens are ordered by how many sets hold them, rarest first. A linked pair shares a token among the first of the larger
    set and among the, fewer, first ones of the smaller. What stands before the token in either set is not in the other, so
    the place of a token bounds the sizes of the sets that it can link: sets meet by token and class of size.
    """
    num, den = likeness.numerator, likeness.denominator
    each = sets.select("num", F.col("n").cast("int").alias("n"), F.explode("tokens").alias("token"))
    counts = store(each.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"))
    met = each.join(counts, "token").groupBy("num", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("first"))
    # The largest prefix that any set needs; tokens of one set alone come before all others.
    most = F.col("n") - F.ceil(F.col("n") * num / den - F.lit(1e-9)) + 1 - (F.col("n") - F.size("first"))
    rows = met.select("num", "n", F.size("first").alias("s"), F.posexplode(F.slice("first", 1, F.greatest(most, F.lit(0)).cast("int"))).alias("i", "t"))
    rows = rows.select("num", "n", F.col("t.token").alias("token"), (F.col("n") - F.col("s") + F.col("i")).alias("pos"))
    rows = store(rows.join(sets.select("num", "label"), "num"))
    # From here n tokens of a set less those before the shared one, and what two sizes demand in common.
    demanded = lambda n, m: F.ceil((n + m) * num / (num + den) - F.lit(1e-9))
    held = rows.where(F.col("n") - F.col("pos") >= demanded(F.col("n"), F.col("n"))).withColumn("bin", _bin(F.col("n")))
    low = F.ceil(F.col("n") * num / den - F.lit(1e-9))
    high = F.least(F.col("n"), F.floor((F.col("n") - F.col("pos")) * (num + den) / num + F.lit(1e-9)) - F.col("n"))
    asked = rows.withColumns({"low": low, "high": high}).where("low <= high").withColumn("bin", F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high")))))
    x, y = asked.alias("x"), held.alias("y")
    left = lambda r: F.col(f"{r}.n") - F.col(f"{r}.pos")
    fits = F.col("y.n").between(F.col("x.low"), F.col("x.high")) & (F.least(left("x"), left("y")) >= demanded(F.col("x.n"), F.col("y.n")))
    once = (F.col("x.n") > F.col("y.n")) | (F.col("x.num") < F.col("y.num"))
    pairs = x.join(y, ["token", "bin"]).where((F.col("x.label") != F.col("y.label")) & (F.col("x.num") != F.col("y.num")) & fits & once)
    out = store(pairs.select(F.col("x.num").alias("a"), F.col("y.num").alias("b")).distinct())
    drop(counts, rows)
    return out


def overlap(a: Column, b: Column, retained: int) -> Column:
    """Values of the union sketch that both sketches retain."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, retained)
    return F.size(F.array_intersect(union, F.array_intersect(a, b)))


def alike_sketches(pairs: DataFrame, sets: DataFrame, retained: int, likeness: Fraction, least: int) -> DataFrame:
    """The set ids (a, b) of the pairs of numbers (a, b) whose union sketch does not rule them out."""
    left = sets.select(F.col("num").alias("a"), F.col("sid").alias("ia"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("num").alias("b"), F.col("sid").alias("ib"), F.col("sketch").alias("sb"))
    both = overlap(F.col("sa"), F.col("sb"), retained)
    whole = F.size(F.array_union("sa", "sb"))
    # A union that is smaller than a sketch is known whole.
    enough = F.when(whole <= retained, likeness.denominator * both >= likeness.numerator * whole).otherwise(both >= least)
    return pairs.join(left, "a").join(right, "b").where(enough).select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def minhash_components(docs: DataFrame, k: int = 5, likeness: Fraction = Fraction(4, 5), retained: int = RETAINED, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when shared / all shingles >= likeness.
    component_id: the smallest doc_id reachable by links; kept: whether that is the row's own.

    Null or empty texts, and texts without a word: no shingles, linked with nothing, kept. Fewer than k words: the sequence
    is the one shingle. Repeated rows each get a row back, with one component, and share `kept`. A null doc_id never becomes
    a component_id while its component has another, and is then not kept. Very long texts have sketches like others. Further
    columns of docs are ignored. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    least = least_overlap(retained, likeness, miss)
    base = sketches(docs, k, retained)
    rep = F.min(F.struct("doc_id", "k1", "k2")).alias("rep")
    sets = store(base.where("n > 0").groupBy("sid", "n").agg(rep, F.first("sketch").alias("sketch")).withColumn("num", F.xxhash64("sid")))
    of = store(base.select("doc_id", "n", "sid"))
    drop(base)
    # Two sets may bear one number: they meet the same lists, and are told apart where sketches and texts are compared.
    rows = inverted_lists(sets, retained, likeness, miss)
    chosen = store(sets.join(rows.select("num").distinct(), "num", "left_semi"))
    drop(sets)
    texts = _texts(docs, chosen)
    num, den = likeness.numerator, likeness.denominator

    def sizes_fit(x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        return den * F.least(nx, ny) >= num * F.greatest(nx, ny)

    # An original meets more sets in its lists than its edited copies do.
    pivots = rows.groupBy("key").agg(F.max(F.struct("weight", "num", "n")).alias("p"), F.count("*").alias("held")).where("held > 1").select("key", "p.num", "p.n")
    star = rows.alias("x").join(pivots.alias("p"), "key").where((F.col("x.num") != F.col("p.num")) & sizes_fit("x", "p"))
    star = store(star.select(F.col("p.num").alias("a"), F.col("x.num").alias("b")).distinct())
    links = store(_verify(alike_sketches(star, chosen, retained, likeness, least), texts, k, likeness).distinct())
    labels = components(links)

    # The rest: pairs of sets whose labels differ.
    label = F.coalesce("label", "sid").alias("label")
    known = chosen.select("num", "sid", "n").join(labels, F.col("sid") == F.col("node"), "left").select("num", "n", "sid", label)
    whole = store(known.join(shingled(texts, k), "sid").drop("sid"))
    found = open_pairs(whole, likeness)
    seen = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = store(found.join(seen, ["a", "b"], "left_anti"))
    drop(whole, found)
    if rest.limit(1).count():
        more = store(links.union(_verify(alike_sketches(rest, chosen, retained, likeness, least), texts, k, likeness)).distinct())
        drop(labels)
        labels = components(more)
        drop(more)
    drop(rest, star, links, texts, chosen, rows)

    # Sets without a link are components of their own; copies of one text are one set.
    least_id = of.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    known = least_id.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "least", label)
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    ends = known.join(smallest, "label").select("sid", "component_id")
    out = of.where("n > 0").join(ends, "sid", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.union(of.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
