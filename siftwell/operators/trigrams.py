"""Scans pruned by trigrams: which files can hold a symbol or match a pattern, from postings of their trigrams.

A pattern becomes a Boolean query of trigrams that every match must contain. Postings are sorted by trigram, so a query reads
few of them; files that pass are then probed as ever, so the result is that of a scan of everything. Trigrams are those of
lower-cased text: one index serves both case modes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import search as ops
from siftwell.operators.parts import parts
from siftwell.sources.corpus import lines_of

MOST_SENT = 100_000
"""Files that are sent to all tasks; more of them meet the files by a shuffle."""
MOST_PARTS = 16
"""Exact texts that a part of a pattern is followed through; with more it is taken as any text."""

# A query is True (any file may match), a trigram, ("and", parts) or ("or", parts).
Query = bool | str | tuple[str, tuple]


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def both(*parts: Query) -> Query:
    kept = tuple(dict.fromkeys(x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)) if x is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def either(*parts: Query) -> Query:
    kept = tuple(dict.fromkeys(parts))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", kept)


def of_text(text: str) -> Query:
    """The trigrams of a text; those beyond ASCII are not asked for, as engines differ in their lower case."""
    return both(*sorted(g for g in grams(text.lower()) if g.isascii()))


def _any_of(texts: set[str]) -> Query:
    return either(*(of_text(t) for t in sorted(texts)))


def of_pattern(pattern: str) -> Query:
    """What every match of a regular expression contains. Classes, repeats and flags that are not followed make it weaker,
    never wrong; a pattern that Python does not read asks for nothing."""
    try:
        tree = syntax.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return True
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return True
    texts, query = _walk(tree)
    return query if texts is None else both(query, _any_of(texts))


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(the exact texts that a sequence stands for, or None if they are not few; what it demands besides)."""
    run, exact, query = {""}, True, True
    for kind, value in tree:
        texts, asked = _part(kind, value)
        query = both(query, asked)
        if texts is not None and len(run) * len(texts) <= MOST_PARTS:
            run = {x + y for x in run for y in texts}
        else:
            # The run ends here; what follows, or the many texts of this part, begin another.
            query, exact = both(query, _any_of(run)), False
            run = texts or {""}
    return (run, query) if exact else (None, both(query, _any_of(run)))


def _part(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value)}, True
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 4:
        return {chr(v) for _, v in value}, True
    if kind is op.AT:
        return {""}, True
    if kind is op.SUBPATTERN:
        _, add, remove, inner = value
        return (None, True) if (add | remove) & (re.IGNORECASE | re.VERBOSE) else _walk(inner)
    if kind is op.BRANCH:
        found = [_walk(x) for x in value[1]]
        if all(t is not None for t, _ in found):
            whole = set().union(*(t for t, _ in found))
            if len(whole) <= MOST_PARTS:
                return whole, either(*(q for _, q in found))
        return None, either(*(q if t is None else both(q, _any_of(t)) for t, q in found))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        if least == 0:
            return None, True
        texts, query = _walk(inner)
        if least == most == 1:
            return texts, query
        return None, query if texts is None else both(query, _any_of(texts))
    return None, True


# The index


def postings(files: DataFrame) -> DataFrame:
    """(gram, files): the trigrams of lower-cased bodies, each with the numbers of some files that hold it. A file's number is
    a hash of its path. Numpy sorts the trigrams of a part of the files, so no trigram of a file is a row or an object."""

    def made(numbers: pa.Array, bodies: pa.Array) -> pa.RecordBatch:
        numbers = numbers.to_numpy()
        texts = ["" if x is None else x for x in bodies.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(x) for x in texts])
        signs, code = np.unique(points, return_inverse=True)
        code, n = code.astype(np.uint64), np.uint64(max(1, len(signs)))
        inside = of[:-2] == of[2:]
        gram = ((code[:-2] * n + code[1:-1]) * n + code[2:])[inside]
        key = np.unique(gram * np.uint64(max(1, len(texts))) + of[:-2][inside])
        gram, of = key // np.uint64(max(1, len(texts))), (key % np.uint64(max(1, len(texts)))).astype(np.int64)
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        first = gram[starts]
        letters = np.stack([signs[(first // n // n).astype(np.int64)], signs[(first // n % n).astype(np.int64)], signs[(first % n).astype(np.int64)]], axis=1) if len(first) else np.zeros((0, 3), np.uint32)
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), pa.array(numbers[of], pa.int64()))
        return pa.RecordBatch.from_arrays([names, lists], names=["gram", "files"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                yield made(*part.columns)

    return files.select(_number().alias("file"), F.lower("body").alias("body")).mapInArrow(run, "gram string, files array<long>")


def _number() -> Column:
    return F.xxhash64("path")


def write(files: DataFrame, folder: str) -> None:
    """Postings in ranges of gram and files, sorted, so that a common trigram has several files and a rare one a part of one."""
    postings(files).repartitionByRange("gram", F.get("files", F.lit(0))).sortWithinPartitions("gram").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(gram, file): file is the number of a path."""
    return spark.read.schema("gram string, files array<long>").parquet(folder).select("gram", F.explode("files").alias("file"))


def _names(query: Query) -> list[str]:
    return [query] if isinstance(query, str) else [] if query is True else sorted({g for p in query[1] for g in _names(p)})


def candidates(held: DataFrame, query: Query) -> DataFrame | None:
    """(file): the numbers of the files that a query allows; None if it allows all. Two paths of one number allow each other,
    which costs a probe and loses nothing."""
    if query is True:
        return None
    names = _names(query)
    place = {g: i for i, g in enumerate(names)}

    def test(q: Query) -> Column:
        if isinstance(q, str):
            return F.col(f"g{place[q]}")
        out = test(q[1][0])
        for p in q[1][1:]:
            out = out & test(p) if q[0] == "and" else out | test(p)
        return out

    some = held.where(F.col("gram").isin(names)).groupBy("file").agg(*(F.max(F.col("gram") == g).alias(f"g{i}") for g, i in place.items()))
    return some.where(test(query)).select("file")


def pruned(files: DataFrame, held: DataFrame, query: Query, most: int = MOST_SENT) -> DataFrame:
    """The files that a query allows. They are counted: the numbers of few are sent to the tasks, many are joined."""
    found = candidates(held, query)
    if found is None:
        return files
    few = found.limit(most + 1).count() <= most
    return files.join(F.broadcast(found) if few else found, _number() == found["file"], "left_semi")


def pruned_probe(files: DataFrame, held: DataFrame, symbol: str, ignore_case: bool = False) -> DataFrame:
    """As search.probe, reading only files that can hold the symbol."""
    return ops.probe(pruned(files, held, of_text(symbol)), symbol, ignore_case)


def pruned_matches(files: DataFrame, held: DataFrame, pattern: str) -> DataFrame:
    """(path, ext, line_no, line): lines that match a regular expression."""
    return lines_of(pruned(files, held, of_pattern(pattern))).where(F.rlike("line", F.lit(pattern)))
