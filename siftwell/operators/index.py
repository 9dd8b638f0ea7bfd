"""Inverted index with positions and BM25 ranking, kept in a folder that follows its files.

The folder holds segments of postings, and versions. A version names its live segments and lists its files (path, stamp,
segment, number) and the dead ones: what older segments still hold of files that have changed or gone, a bit for each.
Opening an index again compares stamps, tokenises new and changed files only into one more segment, and writes a version;
segments are merged when there are many. A version counts from the moment its small JSON file is there, so a lost job leaves
the last one.

A segment's files have numbers, and its postings name no paths. Each task writes the postings of its own files, sorted by
token, so that they never move.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.parts import parts
from siftwell.operators.query_syntax import Node, QueryError, parse
from siftwell.sources.corpus import shared_folder

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
LONGEST = 40
"""Tokens of this many bytes or more are left out."""
MOST_SEGMENTS = 8
POSTINGS = "token string, path string, tf long, dl long, positions array<int>"
SEGMENT = "token string, number long, positions array<int>, path string, stamp long, dl long"
FILES = "path string, stamp long, segment string, number long, dl long"
FORMAT = 2
"""A folder whose version says otherwise is filled anew."""
MOST_SENT = 200_000
"""Rows of dead files' bits, each of 64 files, that are sent to all tasks; more of them meet the postings by a shuffle."""


def _all_tokens(body: Column) -> Column:
    return F.regexp_extract_all(F.lower(body), F.lit(TOKEN), F.lit(0))


def tokens(body: Column) -> Column:
    return F.filter(_all_tokens(body), lambda t: F.octet_length(t) < LONGEST)


def _grouped(words: pa.Array, held: Callable[[pa.Array], pa.Array] | None = None) -> tuple[np.ndarray, ...]:
    """(tokens, which text each is of, tf, places, dl of each text) from lower-cased texts, by text and token.

    RE2 cuts the texts and numpy groups the tokens, so no token is a Python object. held: which tokens are kept.
    """
    cut = pc.split_pattern_regex(words, rf"[^{TOKEN[1:-2]}]+")
    flat, of = cut.flatten(), np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))
    # A text that begins or ends between tokens has an empty piece there.
    some = pc.greater(pc.binary_length(flat), 0)
    flat, of = flat.filter(some), of[some.to_numpy(zero_copy_only=False)]
    counts = np.bincount(of, minlength=len(words))
    places = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    coded = flat.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    good = pc.less(pc.binary_length(names), LONGEST)
    short = good.to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    dl = np.bincount(of[short], minlength=len(words))
    if held is not None:
        good = pc.and_(good, held(names))
    kept = good.to_numpy(zero_copy_only=False)[code] if len(code) else short
    key = of[kept] * max(1, len(names)) + code[kept]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(starts, len(key)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(places[kept][order], pa.int32()))
    return names.take(pa.array(key[starts] % max(1, len(names)))), key[starts] // max(1, len(names)), tf, lists, dl


def _tokenised(files: DataFrame, schema: str, make: Callable[..., list[pa.Array]], *more: str) -> DataFrame:
    """What make gives for (paths, lower-cased bodies) and more columns, part by part."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                yield pa.RecordBatch.from_arrays(make(*part.columns), names=names)

    return files.select("path", F.lower("body").alias("body"), *more).mapInArrow(run, schema)


def postings(files: DataFrame) -> DataFrame:
    """(token, path, tf). A file's tokens are grouped in its row; only where a path comes more than once rows meet."""

    def make(paths: pa.Array, bodies: pa.Array) -> list[pa.Array]:
        tokens_, of, tf, _, _ = _grouped(bodies)
        return [tokens_, paths.take(pa.array(of)), pa.array(tf, pa.int64())]

    found = _tokenised(files, "token string, path string, tf long", make)
    once = not files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return found if once else found.groupBy("token", "path").agg(F.sum("tf").alias("tf"))


def positional_postings(files: DataFrame) -> DataFrame:
    """(token, path, tf, dl, positions): where a token stands in its file, and how many tokens the file has. A file is one
    row, so its tokens are grouped there and nothing moves. Places count tokens that are left out, too.

    Of files with a number and a stamp the rows are a segment's: postings have the file's number, and one row without a token
    holds its path, stamp and length."""

    def numbered(paths: pa.Array, bodies: pa.Array, numbers: pa.Array, stamps: pa.Array) -> list[pa.Array]:
        tokens_, of, _, places, dl = _grouped(bodies)
        n, m = len(paths), len(of)
        joined = [(tokens_, pa.nulls(n, pa.string())), (numbers.take(pa.array(of)), numbers), (places, pa.nulls(n, places.type))]
        joined += [(pa.nulls(m, pa.string()), paths), (pa.nulls(m, pa.int64()), stamps), (pa.nulls(m, pa.int64()), pa.array(dl, pa.int64()))]
        return [pa.concat_arrays(x) for x in joined]

    if "number" in files.columns:
        return _tokenised(files, SEGMENT, numbered, "number", "stamp")

    def make(paths: pa.Array, bodies: pa.Array) -> list[pa.Array]:
        tokens_, of, tf, places, dl = _grouped(bodies)
        return [tokens_, paths.take(pa.array(of)), pa.array(tf, pa.int64()), pa.array(dl[of], pa.int64()), places]

    return _tokenised(files, POSTINGS, make)


def sized_postings(files: DataFrame) -> DataFrame:
    """(token, path, tf, dl): as positional_postings, without the places."""

    def make(paths: pa.Array, bodies: pa.Array) -> list[pa.Array]:
        tokens_, of, tf, _, dl = _grouped(bodies)
        return [tokens_, paths.take(pa.array(of)), pa.array(tf, pa.int64()), pa.array(dl[of], pa.int64())]

    return _tokenised(files, "token string, path string, tf long, dl long", make)


def doc_stats(files: DataFrame) -> DataFrame:
    """(path, dl): tokens of each file."""
    return _tokenised(files, "path string, dl long", lambda paths, bodies: [paths, pa.array(_grouped(bodies)[4], pa.int64())])


def asked_postings(files: DataFrame, query: str) -> DataFrame:
    """(token, path, tf, dl, positions): of each file the postings that a query needs, and one row without a token that holds
    its length. One pass; the rows go to the shared folder, as a search reads them more than once."""
    node = parse(query, tokenise)
    leaves = list(node.leaves()) if node else []
    words = pa.array(sorted({w for leaf in leaves for _, w in leaf.words}), pa.string())
    bounds = [leaf.bounds for leaf in leaves if leaf.kind == "range"]

    def held(names: pa.Array) -> pa.Array:
        out = pc.is_in(names, value_set=words)
        for low, high in bounds:
            test = pa.array(np.ones(len(names), bool))
            if low:
                test = pc.and_(test, (pc.greater_equal if low[1] else pc.greater)(names, pa.scalar(low[0], pa.string())))
            if high:
                test = pc.and_(test, (pc.less_equal if high[1] else pc.less)(names, pa.scalar(high[0], pa.string())))
            out = pc.or_(out, test)
        return out

    def make(paths: pa.Array, bodies: pa.Array) -> list[pa.Array]:
        tokens_, of, tf, places, dl = _grouped(bodies, held)
        n = len(paths)
        joined = [(tokens_, pa.nulls(n, pa.string())), (paths.take(pa.array(of)), paths), (pa.array(tf, pa.int64()), pa.nulls(n, pa.int64())), (pa.array(dl[of], pa.int64()), pa.array(dl, pa.int64())), (places, pa.nulls(n, places.type))]
        return [pa.concat_arrays(x) for x in joined]

    folder = shared_folder(files.sparkSession, "asked")
    _tokenised(files, POSTINGS, make).write.parquet(folder)
    return files.sparkSession.read.schema(POSTINGS).parquet(folder)


# What is asked


def tokenise(text: str) -> list[tuple[int, str]]:
    """(place, token) of a query's text, as the index has them."""
    return [(i, w) for i, w in enumerate(regex.findall(TOKEN, text.lower())) if len(w.encode()) < LONGEST]


def query_tokens(query: str) -> list[str]:
    """The tokens of a query's words; none for a blank query."""
    node = parse(query, tokenise)
    return sorted({w for leaf in node.leaves() for _, w in leaf.words}) if node else []


def _held(node: Node) -> Column:
    """Which postings a query needs."""
    words = sorted({w for leaf in node.leaves() for _, w in leaf.words})
    test = F.col("token").isin(words)
    for leaf in node.leaves():
        if leaf.kind == "range":
            test = test | _in_range(leaf)
    return test


def _in_range(leaf: Node) -> Column:
    low, high = leaf.bounds
    test = F.lit(True)
    if low:
        test = test & (F.col("token") >= low[0] if low[1] else F.col("token") > low[0])
    if high:
        test = test & (F.col("token") <= high[0] if high[1] else F.col("token") < high[0])
    return test


def in_a_row(places: list[tuple[int, Column]]) -> Column:
    """How often words stand at these places to one another, from their position arrays."""
    (at, first), rest = places[0], places[1:]

    def follows(x: Column) -> Column:
        test = F.lit(True)
        for place, positions in rest:
            test = test & F.array_contains(positions, (x + (place - at)).cast("int"))
        return test

    return F.size(F.filter(first, follows))


def matches(found: DataFrame, n: int, total: int, query: str, paths: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(path, bm25) of the files that a query matches, from postings (POSTINGS), the number of files and their tokens.

    A file's postings of the query's words meet in one row; phrases, groups and scores are expressions on it. A phrase has
    the sum of its words' idf and counts as often as it occurs; a range and * have the score of their weight. paths: all
    files, which only * needs. numbered: postings have no path and no dl but segment and number; paths has them all. A blank query finds nothing, a senseless one raises QueryError.
    """
    node = parse(query, tokenise)
    if node is None:
        return found.sparkSession.createDataFrame([], "path string, bm25 double")
    words = sorted({w for leaf in node.leaves() for _, w in leaf.words})
    ranges = [leaf for leaf in node.leaves() if leaf.kind == "range"]
    found = found.where(_held(node))
    # As many rows as the query has words.
    df = dict(found.where(F.col("token").isin(words)).groupBy("token").agg(F.count("*")).collect())
    phrases = any(len(leaf.words) > 1 for leaf in node.leaves())
    kept = F.struct("tf", "positions") if phrases else F.struct("tf")
    made = [F.max(F.when(F.col("token") == w, kept)).alias(f"w{i}") for i, w in enumerate(words)]
    made += [F.max(_in_range(leaf)).alias(f"r{i}") for i, leaf in enumerate(ranges)]
    if numbered:
        key = ["segment", "number"]
        rows = found.groupBy(*key).agg(*made).join(paths.select(*key, "path", "dl"), key).drop(*key)
    else:
        rows = found.groupBy("path").agg(F.max("dl").alias("dl"), *made)
    if any(leaf.kind == "all" for leaf in node.leaves()):
        if paths is None:
            raise QueryError("* needs the list of files")
        rows = paths.select("path").join(rows, "path", "left")

    def idf(w: str) -> float:
        return math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))

    norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.lit(total / n if n and total else 1.0))

    def leaf_score(leaf: Node) -> Column:
        """Null where a leaf does not match."""
        if leaf.kind == "all":
            return F.lit(leaf.weight)
        if leaf.kind == "range":
            return F.when(F.col(f"r{ranges.index(leaf)}"), F.lit(leaf.weight))
        if not leaf.words:
            return F.lit(None).cast("double")
        held = [(at, F.col(f"w{words.index(w)}")) for at, w in leaf.words]
        tf = held[0][1]["tf"] if len(held) == 1 else in_a_row([(at, c["positions"]) for at, c in held])
        every = F.lit(True)
        for _, c in held:
            every = every & c.isNotNull()
        weight = leaf.weight * sum(idf(w) for _, w in leaf.words)
        return F.when(every & (tf > 0), F.lit(weight) * tf * (K1 + 1) / (tf + norm))

    def score(part: Node) -> Column:
        if part.kind != "group":
            return leaf_score(part)
        sides: dict[str, list[Column]] = {"must": [], "should": [], "not": []}
        for sign, p in part.parts:
            sides[sign].append(score(p))
        asked = F.lit(True)
        for x in sides["must"]:
            asked = asked & x.isNotNull()
        for x in sides["not"]:
            asked = asked & x.isNull()
        if not sides["must"]:
            asked = asked & (F.coalesce(*sides["should"]).isNotNull() if sides["should"] else F.lit(False))
        whole = F.lit(0.0)
        for x in sides["must"] + sides["should"]:
            whole = whole + F.coalesce(x, F.lit(0.0))
        return F.when(asked, whole * part.weight)

    return rows.select("path", F.round(score(node), 6).alias("bm25")).where("bm25 IS NOT NULL")


def best(matched: DataFrame, most: int) -> DataFrame:
    return matched.orderBy(F.col("bm25").desc(), "path").limit(most)


def bm25(files: DataFrame, query: str) -> DataFrame:
    """(path, bm25) of a query's files, without a stored index."""
    found = asked_postings(files, query)
    whole = found.where("token IS NULL")
    n, total = whole.agg(F.count("*"), F.sum("dl")).first()
    return matches(found.where("token IS NOT NULL"), n, total or 0, query, whole.select("path"))


# The folder


@dataclass
class Version:
    """What a version's JSON file says."""

    number: int = 0
    segments: list[str] = field(default_factory=list)
    n: int = 0
    total: int = 0
    dead: int = 0
    format: int = FORMAT


class Index:
    """An index in a folder. refresh() makes it follow a table of files; matches() asks it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = self._latest()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> Version:
        path, fs = self._path("versions")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(x.removesuffix(".json")) for x in names if x.endswith(".json")]
        if not numbers:
            return Version()
        path, fs = self._path(f"versions/{max(numbers):08d}.json")
        stream = fs.open(path)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        said = json.loads(text)
        return Version(**said) if said.get("format") == FORMAT else Version(max(numbers))

    def _commit(self, version: Version) -> None:
        """The version's file appears whole: it is written under another name first."""
        path, fs = self._path(f"versions/{version.number:08d}.json")
        draft, _ = self._path(f"versions/{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        if not fs.rename(draft, path):
            raise OSError(f"version {version.number} of {self.folder} was written by another")
        self.version = version

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version.segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/tables/{self.version.number:08d}/{name}")

    @property
    def files(self) -> DataFrame:
        """(path, stamp, segment, number, dl) of the files that the version knows."""
        return self._table("files", FILES)

    @property
    def dead(self) -> DataFrame:
        """(segment, word, bits): a bit for each of the 64 numbers from 64 * word, set if the segment's file has changed or gone."""
        return self._table("dead", "segment string, word long, bits long")

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(f"{self.folder}/segments/{name}")

    def live(self, test: Column | None = None) -> DataFrame:
        """(token, segment, number, positions): live postings, those that pass a test of token. A segment's parts are sorted
        by token, so a test skips most row groups."""
        found = self.spark.createDataFrame([], "token string, segment string, number long, positions array<int>")
        for name in self.version.segments:
            part = self._segment(name).where("token IS NOT NULL")
            found = found.union((part if test is None else part.where(test)).select("token", F.lit(name).alias("segment"), "number", "positions"))
        if not self.version.dead:
            return found
        dead = F.broadcast(self.dead) if self.version.dead <= MOST_SENT else self.dead
        met = found.withColumn("word", F.shiftright("number", 6)).join(dead, ["segment", "word"], "left")
        gone = F.expr("getbit(bits, cast(number & 63 AS int)) = 1")
        return met.where(F.col("bits").isNull() | ~gone).select(found.columns)

    def postings(self, test: Column | None = None) -> DataFrame:
        """(token, path, tf, dl, positions): live postings with their files."""
        found = self.live(test).join(self.files, ["segment", "number"])
        return found.select("token", "path", F.size("positions").cast("long").alias("tf"), "dl", "positions")

    def _write_segment(self, held: DataFrame) -> str:
        """Each task's rows, sorted by token; they don't move, so what is written is all that a segment takes."""
        name = uuid.uuid4().hex
        held.sortWithinPartitions("token", "number").write.option("compression", "zstd").parquet(f"{self.folder}/segments/{name}")
        return name

    def _commit_tables(self, number: int, segments: list[str], files: DataFrame, dead: DataFrame) -> None:
        """A version with these files and dead ones: (segment, number)."""
        tables = f"{self.folder}/tables/{number:08d}"
        files.select(*(f.split()[0] for f in FILES.split(", "))).write.mode("overwrite").parquet(f"{tables}/files")
        bit = F.expr("shiftleft(1L, cast(number & 63 AS int))")
        bits = dead.select("segment", F.shiftright("number", 6).alias("word"), bit.alias("bits")).union(self.dead.where(F.col("segment").isin(segments)))
        bits.groupBy("segment", "word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(f"{tables}/dead")
        n, total = self.spark.read.parquet(f"{tables}/files").agg(F.count("*"), F.sum("dl")).first()
        self._commit(Version(number, segments, n, total or 0, self.spark.read.parquet(f"{tables}/dead").count()))

    def refresh(self, files: DataFrame) -> dict[str, int]:
        """Follow files (path, body, and stamp or what a stamp is made of); returns how many were added, changed, removed.

        A file's stamp says whether it is still the same: see stamped(). Only files with a new stamp are tokenised, and once.
        """
        number = self.version.number + 1
        tables = f"{self.folder}/tables/{number:08d}"
        files = stamped(files).select("path", "body", "stamp")
        known = self.files.withColumnsRenamed({"stamp": "old", "number": "at"})
        seen = files.select("path", "stamp").join(known, "path", "full_outer")
        state = F.when(F.col("stamp").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("stamp") != F.col("old"), "changed").otherwise("same")
        # Stamps are made of bodies, so they are compared once and the outcome is written.
        seen.withColumn("state", state).write.mode("overwrite").parquet(f"{tables}/compared")
        compared = self.spark.read.parquet(f"{tables}/compared")
        found = dict(compared.groupBy("state").count().collect())
        counts = dict.fromkeys(("added", "changed", "removed"), 0) | {k: v for k, v in found.items() if k != "same"}
        if self.version.segments and not any(counts.values()):
            return counts
        fresh = files.join(compared.where("state IN ('added', 'changed')").select("path"), "path", "left_semi") if "same" in found else files
        # A task numbers its files and writes their numbers with their postings, so they agree even if it runs twice.
        name = self._write_segment(positional_postings(fresh.withColumn("number", F.monotonically_increasing_id())))
        new = self._segment(name).where("token IS NULL").withColumn("segment", F.lit(name))
        same = compared.where("state = 'same'").select("path", "stamp", "segment", F.col("at").alias("number"), "dl")
        dead = compared.where("state IN ('changed', 'removed')").select("segment", F.col("at").alias("number"))
        segments = [*self.version.segments, name]
        self._commit_tables(number, segments, same.unionByName(new.select(same.columns)), dead)
        if len(segments) > MOST_SEGMENTS:
            self.merge()
        return counts

    def merge(self) -> None:
        """All live postings as one segment. Earlier versions stay readable until their folders are deleted."""
        number = self.version.number + 1
        folder = f"{self.folder}/tables/{number:08d}/numbered"
        self.files.withColumnsRenamed({"number": "at"}).withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
        numbered = self.spark.read.parquet(folder)
        found = self.live().withColumnRenamed("number", "at").join(numbered.select("segment", "at", "number"), ["segment", "at"])
        none = {c: F.lit(None) for c in ("path", "stamp", "dl")}
        rows = numbered.withColumns({"token": F.lit(None).cast("string"), "positions": F.lit(None).cast("array<int>")})
        name = self._write_segment(found.withColumns(none).select("token", "number", "positions", *none).union(rows.select("token", "number", "positions", *none)))
        self._commit_tables(number, [name], numbered.withColumn("segment", F.lit(name)), numbered.select("segment", "number").where("false"))

    def vacuum(self) -> None:
        """Delete what the newest version does not need. Readers of older ones must be done."""
        names = {"segments": set(self.version.segments), "tables": {f"{self.version.number:08d}"}, "versions": {f"{self.version.number:08d}.json"}}
        for top, kept in names.items():
            path, fs = self._path(top)
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)

    def matches(self, query: str) -> DataFrame:
        """(path, bm25) of the files that a query matches."""
        node = parse(query, tokenise)
        held = self.live(F.lit(False) if node is None else _held(node)).withColumn("tf", F.size("positions").cast("long"))
        return matches(held, self.version.n, self.version.total, query, self.files, numbered=True)


def stamped(files: DataFrame) -> DataFrame:
    """files with a stamp of what tells versions apart: length and time of change where there is one, else the body itself."""
    if "stamp" in files.columns:
        return files
    made = F.xxhash64("n_bytes", "modified") if "modified" in files.columns else F.xxhash64("body")
    return files.withColumn("stamp", made)
