"""Many symbols at once: one automaton of all symbols and their variants, one pass over each body, and stages by symbol.

A pass finds every occurrence of every pattern, whatever their number, so n symbols cost one scan and not n. Patterns are
dealt into automata of a bounded size, each sent to the tasks; more symbols mean more passes. Where counts or the best hits
are asked for, a pass goes word by word (words.py), and tasks hand on counts or first hits instead of every hit.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import rewrite
from siftwell.operators import search as ops
from siftwell.operators.parts import parts
from siftwell.operators.words import Words
from siftwell.sources.corpus import shared_folder

CHARACTERS = 4_000_000
"""Characters of the patterns of one automaton: some hundred MB in a task."""
AT_ONCE = 10_000
"""Hits that a task holds before it hands them on: a body may have thousands, a batch of bodies millions."""
HITS = "path string, ext string, symbol string, line_no long, variants array<int>"
NAMES = ["path", "ext", "symbol", "line_no", "variants"]
KINDS = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
COUNTS = "symbol string, lines long, files long, first_path string"
BYTES = 1 << 22
"""Bytes of text whose distinct words are looked at together."""
RETIRED = 0.7
"""A task drops the symbols that it has settled once so few of those it looks for are open."""


@lru_cache(2)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    held = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        held.add_word(p, (i, len(p)))
    held.make_automaton()
    return held


def _found(automaton, body: str, owners: list[list[tuple[int, int]]], most: int | None) -> Iterator[tuple[int, int, list[int]]]:
    """(symbol, line, variants) of a body, line by line; of each symbol the first `most` lines. Only one line's hits are held."""
    ends = [m.start() for m in re.finditer("\n", body)]
    now, held, met, size = 0, {}, Counter(), len(ends)
    stop = ends[0] if size else len(body)

    def line_found() -> Iterator[tuple[int, int, list[int]]]:
        for symbol, variants in held.items():
            if most is None or met[symbol] < most:
                met[symbol] += 1
                # Every variant holds the symbol itself, variant 0.
                yield symbol, now + 1, sorted(variants)

    for end, (p, _) in automaton.iter(body):
        # Occurrences come by where they end. A pattern holds no line end, so its first character is on the same line.
        if end > stop:
            yield from line_found()
            held = {}
            now = bisect_left(ends, end, now)
            stop = ends[now] if now < size else len(body)
        for symbol, variant in owners[p]:
            held.setdefault(symbol, set()).add(variant)
    yield from line_found()


def _patterns(symbols: list[str], language: str | None, fold: bool) -> tuple[tuple[str, ...], list[list[tuple[int, int]]]]:
    """Distinct patterns, and which symbols and variants each stands for."""
    made: dict[str, list[tuple[int, int]]] = {}
    for s, symbol in enumerate(symbols):
        for v, text in enumerate(rewrite.variants(symbol, language)):
            text = text.lower() if fold else text
            if "\n" not in text and (s, v) not in made.setdefault(text, []):
                made[text].append((s, v))
    return tuple(made), list(made.values())


def batch_probe(files: DataFrame, symbols: DataFrame, language: str | None = None, most: int | None = None) -> DataFrame:
    """(path, ext, symbol, line_no, variants): lines that hold a symbol, of each symbol and file the first `most`.

    variants: the places of the symbol's variants (rewrite.variants) that the line holds. Case counts as in a single search:
    letters match in either case only for a symbol of which no variant has an upper-case letter. Symbols are trimmed; blank
    ones, and null ones, find nothing.
    """
    spark = files.sparkSession
    wanted = symbols.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()
    out = spark.createDataFrame([], HITS)
    for chunk in _chunks(wanted, language):
        for fold in (False, True):
            some = [s for s in chunk if rewrite.insensitive(s, language) == fold]
            if any("\n" not in s for s in some):
                out = out.union(_pass(files, some, language, fold, most))
    return out


def _chunks(wanted: DataFrame, language: str | None) -> Iterator[list[str]]:
    """Symbols in parts whose variants fit one automaton. They reach the driver part by part."""
    held, size = [], 0
    for r in wanted.toLocalIterator():
        more = sum(map(len, rewrite.variants(r.symbol, language)))
        if held and size + more > CHARACTERS:
            yield held
            held, size = [], 0
        held.append(r.symbol)
        size += more
    if held:
        yield held


def _pass(files: DataFrame, symbols: list[str], language: str | None, fold: bool, most: int | None) -> DataFrame:
    patterns, owners = _patterns(symbols, language, fold)
    sent = files.sparkSession.sparkContext.broadcast((symbols, patterns, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, patterns, owners = sent.value
        automaton = _automaton(patterns)
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES)

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            for part in parts(batch, 2):
                for path, ext, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if body:
                        yield from ((path, ext, symbols[s], n, v) for s, n, v in _found(automaton, body, owners, most))

        for batch in batches:
            found = each(batch)
            while rows := list(islice(found, AT_ONCE)):
                yield made(rows)

    body = F.lower("body") if fold else F.col("body")
    return files.select("path", "ext", body.alias("body")).mapInArrow(run, HITS)


def _texts(symbols: list[str], language: str | None, fold: bool) -> Iterator[dict[str, str]]:
    """Symbols by what is looked for. Two that differ in case only go to different passes."""
    some = [s for s in symbols if rewrite.insensitive(s, language) == fold and "\n" not in s]
    while some:
        made, again = {}, []
        for s in some:
            text = s.lower() if fold else s
            if made.setdefault(text, s) != s:
                again.append(s)
        yield made
        some = again


def _wordwise(files: DataFrame, symbols: DataFrame, language: str | None, make: Callable, schema: str) -> DataFrame:
    """The passes over (path, ext, body) that make(looked for, symbols, fold) turns into rows, as one table."""
    wanted = symbols.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()
    out = files.sparkSession.createDataFrame([], schema)
    for chunk in _chunks(wanted, language):
        for fold in (False, True):
            for texts in _texts(chunk, language, fold):
                body = F.lower("body") if fold else F.col("body")
                sent = files.sparkSession.sparkContext.broadcast((list(texts), list(texts.values())))
                out = out.union(files.select("path", "ext", body.alias("body")).mapInArrow(make(sent, fold), schema))
    return out


@lru_cache(2)
def _words(symbols: tuple[str, ...]) -> Words:
    return Words(list(symbols))


def batch_counts(files: DataFrame, symbols: DataFrame, language: str | None = None) -> DataFrame:
    """(symbol, lines, files, first_path): how many of the lines that batch_probe finds, in how many files, and the first one.

    A task counts its files, so it hands on one row for a symbol. Paths that come more than once are counted one by one.
    """

    def make(sent, each: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            looked, names = sent.value
            words, n = _words(tuple(looked)), len(looked)
            lines, held, first = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            names = pa.array(names, pa.string())

            def rows(symbol: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(symbol)), *columns], names=["symbol", "lines", "files", "first_path"])

            for batch in batches:
                for part in parts(batch, 2, BYTES):
                    found, paths = words.find(part.column(2)), part.column(0).to_pylist()
                    # Of each file and symbol the number of lines, files in the order of their paths.
                    order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
                    place = np.argsort(order)
                    key, many = np.unique(place[found.row[found.line]] * n + found.symbol, return_counts=True)
                    file, symbol = order[key // n], key % n
                    if each:
                        yield rows(symbol, pa.array(many, pa.int64()), pa.array(np.ones(len(key), np.int64)), part.column(0).take(pa.array(file)))
                        continue
                    lines += np.bincount(found.symbol, minlength=n)
                    held += np.bincount(symbol, minlength=n)
                    met, at = np.unique(symbol, return_index=True)
                    for s, f in zip(met.tolist(), file[at].tolist(), strict=True):
                        if first[s] is None or paths[f] < first[s]:
                            first[s] = paths[f]
            some = np.flatnonzero(lines)
            yield rows(some, pa.array(lines[some]), pa.array(held[some]), pa.array([first[s] for s in some.tolist()], pa.string()))

        return run

    counted = [F.sum("lines").alias("lines"), F.sum("files").alias("files"), F.min("first_path").alias("first_path")]
    twice = files.groupBy("path").count().where("count > 1").select("path")
    if not twice.limit(1).count():
        return _wordwise(files, symbols, language, lambda sent, _: make(sent, False), COUNTS).groupBy("symbol").agg(*counted)
    once = _wordwise(files.join(twice, "path", "left_anti"), symbols, language, lambda sent, _: make(sent, False), COUNTS)
    again = _wordwise(files.join(twice, "path", "left_semi"), symbols, language, lambda sent, _: make(sent, True), COUNTS)
    again = again.groupBy("symbol", "first_path").agg(F.sum("lines").alias("lines")).select("symbol", "lines", F.lit(1).cast("long").alias("files"), "first_path")
    return once.union(again).groupBy("symbol").agg(*counted)


def first_hits(files: DataFrame, symbols: DataFrame, best: int, language: str | None = None, most: int | None = None) -> DataFrame:
    """The hits of batch_probe that are among the first `best` of their symbol by path and line.

    A task takes its files by path, so a symbol that has its hits is looked for no longer, and hands on few hits.
    """
    cap = best if most is None else min(best, most)

    def make(sent, fold: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            looked, names = sent.value
            words, ids = _words(tuple(looked)), np.arange(len(looked))
            # Hits in files before the last path, and in those of the last path.
            before, latest, last = np.zeros(len(looked), np.int64), np.zeros(len(looked), np.int64), None
            forms = lru_cache(None)(lambda s: [t.lower() if fold else t for t in rewrite.variants(names[s], language)])
            for batch in batches:
                for part in parts(batch, 2, BYTES):
                    if (before < best).sum() <= RETIRED * len(ids):
                        ids = np.flatnonzero(before < best)
                        words = Words([looked[i] for i in ids])
                    if not len(ids):
                        continue
                    found, paths = words.find(part.column(2)), part.column(0).to_pylist()
                    group = np.cumsum([i > 0 and p != paths[i - 1] for i, p in enumerate(paths)])
                    going = paths[0] == last
                    if not going:
                        before, latest = before + latest, np.zeros_like(latest)
                    symbol, line = ids[found.symbol], found.line
                    # Hits by symbol in the order of files and lines; of each symbol and file the first `cap`.
                    order = np.argsort(symbol, kind="stable")
                    symbol, line = symbol[order], line[order]
                    kept = _rank(symbol * len(paths) + found.row[line]) < cap
                    symbol, line = symbol[kept], line[kept]
                    path = group[found.row[line]]
                    rank, inside = _rank(symbol), _rank(symbol * len(paths) + path)
                    ahead = before[symbol] + np.where(going & (path == 0), 0, latest[symbol] + rank - inside)
                    closed = path < group[-1] if len(paths) else path
                    if group[-1] > 0:
                        before = before + latest + np.bincount(symbol[closed], minlength=len(looked))
                        latest = np.bincount(symbol[~closed], minlength=len(looked))
                    else:
                        latest = latest + np.bincount(symbol, minlength=len(looked))
                    last = paths[-1]
                    symbol, line = symbol[ahead < best], line[ahead < best]
                    row = pa.array(found.row[line])
                    read = lru_cache(64)(found.read)
                    variants = [None] * len(line)
                    for i in np.argsort(line, kind="stable").tolist():
                        text = read(line[i])
                        variants[i] = [v for v, t in enumerate(forms(symbol[i])) if t in text]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(row), part.column(1).take(row), pa.array([names[s] for s in symbol.tolist()], pa.string()), pa.array(found.number[line], pa.int64()), pa.array(variants, pa.list_(pa.int32()))],
                        names=NAMES,
                    )

        return run

    found = _wordwise(files.select("path", "ext", "body").sortWithinPartitions("path"), symbols, language, make, HITS)
    # Spark cuts each task's rows to the first ones of a symbol before they move.
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("path", "line_no"))
    return found.withColumn("_n", place).where(F.col("_n") <= best).drop("_n")


def _rank(keys: np.ndarray) -> np.ndarray:
    """The place of each among its equals, which lie together."""
    if not len(keys):
        return keys
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))


def candidate_hits(files: DataFrame, candidates: DataFrame, language: str | None = None, most: int | None = None) -> DataFrame:
    """The hits of batch_probe in the candidates (symbol, path): of each symbol only those in its own files."""
    asked = candidates.groupBy("path").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = lru_cache(10_000)(lambda s: (rewrite.insensitive(s, language), rewrite.variants(s, language)))
        for batch in batches:
            for part in parts(batch, 2, BYTES):
                rows = []
                for path, ext, body, low, symbols in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    lines = {fold: [x.removesuffix("\r") for x in (text or "").split("\n")] for fold, text in ((False, body), (True, low))}
                    for symbol in symbols:
                        fold, texts = forms(symbol)
                        texts = [t.lower() if fold else t for t in texts]
                        hits = ((i, x) for i, x in enumerate(lines[fold]) if texts[0] in x)
                        rows += [(path, ext, symbol, i + 1, [v for v, t in enumerate(texts) if t in x]) for i, x in islice(hits, most)]
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=pa.schema(list(zip(NAMES, KINDS, strict=True))))

    held = files.join(asked, "path").select("path", "ext", "body", F.lower("body").alias("low"), "symbols")
    return held.mapInArrow(run, HITS)


def named_files(files: DataFrame, symbols: list[str], most: int) -> DataFrame:
    """(symbol, path, pos): of each symbol the first `most` files by path whose name matches it, a dot standing for any sign
    in a symbol of letters, digits and dots. The automaton holds the longest part between dots, the whole is tested after."""

    def part(symbol: str) -> str:
        return max(symbol.split("."), key=len) if re.fullmatch(r"[A-Za-z0-9_.]+", symbol) else symbol

    owners: dict[str, list[tuple[str, str]]] = {}
    for s in symbols:
        if "\n" not in s:
            owners.setdefault(part(s), []).append((s, s if re.fullmatch(r"[A-Za-z0-9_.]+", s) else re.escape(s)))
    always = owners.pop("", [])
    sent = files.sparkSession.sparkContext.broadcast((tuple(owners), list(owners.values()), always))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, owners, always = sent.value
        automaton = _automaton(patterns)
        for batch in batches:
            rows = []
            for path, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = {x for _, (p, _) in automaton.iter(name) for x in owners[p]} if patterns else set()
                rows += [(s, path) for s, needle in asked.union(always) if re.search(needle, name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["symbol", "path"])

    met = files.select("path", "name").mapInArrow(run, "symbol string, path string")
    # Spark cuts each task's rows to the first ones of a symbol before they move.
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("path"))
    return met.withColumn("pos", place).where(F.col("pos") <= most)


def batch_search(files: DataFrame, symbols: DataFrame, language: str | None = None, max_matches: int = 20, named: int = 200, best: int | None = None) -> DataFrame:
    """(symbol, stage, path, ext, line_no, variants, score): what a search for each symbol finds, in the first of its stages
    that finds anything, as a search without structure, index and pages does.

    All stages probe the same lines, so one pass serves them: a literal symbol takes its hits everywhere; another one those in
    the first `max_matches` of its candidate files, or everywhere if it has none; symbols solved there leave, and what is left
    takes its hits everywhere. Candidates are files named like the symbol. best: only hits are needed that can be among so many
    best ones of their symbol (top_of_each). Those are hits in candidates, and of others the first by path and line.
    """
    spark = files.sparkSession

    def stored(found: DataFrame, name: str) -> DataFrame:
        # Hits may be many times the bodies: they go to the shared folder, not to the executors' memory.
        folder = shared_folder(spark, name)
        found.write.parquet(folder)
        return spark.read.schema(found.schema).parquet(folder)

    hits = stored(batch_probe(files, symbols, language, max_matches) if best is None else first_hits(files, symbols, best, language, max_matches), "hits")
    literal = rewrite.is_literal_symbol(F.col("symbol"))
    first = hits.where(literal).withColumn("stage", F.lit("rg-global"))
    rest = hits.where(~literal)
    # Only symbols that some line holds can be solved by candidates; the driver sends their names back as patterns.
    asked = [r.symbol for r in rest.select("symbol").distinct().toLocalIterator()]
    candidates = stored(named_files(_eligible(files, language), asked, named), "candidates")
    flagged = candidates.select("symbol", "path").distinct().withColumn("_c", F.lit(True))
    if best is not None:
        rest = rest.join(flagged, ["symbol", "path"], "left_anti").select(rest.columns).union(candidate_hits(files, candidates, language, max_matches))
        rest = stored(rest, "hits")
    scope = candidates.where(F.col("pos") <= max_matches).select("symbol", "path")
    inside = rest.join(scope, ["symbol", "path"], "left_semi").select(rest.columns).union(rest.join(scope.select("symbol").distinct(), "symbol", "left_anti").select(rest.columns))
    inside = inside.withColumn("stage", F.lit("rg-scoped"))
    unsolved = rest.join(inside.select("symbol").distinct(), "symbol", "left_anti").select(*rest.columns, F.lit("rg-global").alias("stage"))
    # A literal symbol has no candidates, so its hits, which are most, stay out of the join.
    found = inside.unionByName(unsolved).join(flagged, ["symbol", "path"], "left").unionByName(first.withColumn("_c", F.lit(None).cast("boolean")))
    base = F.when(F.col("stage") == "rg-global", sum(ops.ORIGINS["rg-global"])).otherwise(sum(ops.ORIGINS["rg-scoped"]))
    scored = found.withColumn("score", base + F.when(F.col("_c"), ops.CANDIDATE_BONUS).otherwise(0.0))
    return scored.select("symbol", "stage", "path", "ext", "line_no", "variants", "score")


def _eligible(files: DataFrame, language: str | None) -> DataFrame:
    extensions = rewrite.extensions_of([language]) if language else []
    return files.where(F.col("ext").isin(extensions)) if extensions else files


def top_of_each(found: DataFrame, most: int = 5) -> DataFrame:
    """The best hits of each symbol with their rank."""
    order = Window.partitionBy("symbol").orderBy(F.round("score", 6).desc(), "path", "line_no")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
