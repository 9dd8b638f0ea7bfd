"""Importance resampling towards a target distribution of hashed n-grams.

Each task runs DuckDB on the texts of a batch: SQL unnests the words, a window pairs each with the next one, and zlib's CRC,
registered as a function, gives each n-gram its bucket. A document's buckets and their counts, as arrays, are spilled to
Parquet in the shared folder. Spark merges them, makes one gain for each bucket from the two distributions, and scores the
documents from the spilled counts; texts are read once.

The draw is by exponential noise (Gumbel top-k): the highest sums of log weight and noise are a sample without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import drop, map_text, store

BUCKETS = 10_000
TASK_MB = 200
"""What DuckDB may hold in a task; a slab of texts needs far less. It has no folder to spill to: what is spilled is Parquet in
the shared folder."""
SLAB = 400
PIECE = 1 << 19
"""Characters of a text that DuckDB gets at once; longer texts come in pieces that share a word."""
_WORD = re.compile("[0-9A-Za-z\x80-\U0010FFFF]+")
_GAPS = "".join(chr(c) for c in range(128) if not _WORD.match(chr(c)))

FEATURES = """
WITH texts AS (SELECT row, continued, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM slab),
words AS (SELECT row, continued, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
pairs AS (SELECT row, place > 1 OR NOT continued AS own, word, lead(word) OVER (PARTITION BY row ORDER BY place) AS next FROM words),
grams AS MATERIALIZED (SELECT row, word AS gram FROM pairs WHERE own UNION ALL SELECT row, word || ' ' || next FROM pairs WHERE next IS NOT NULL),
met AS (SELECT list(gram) AS all_grams FROM (SELECT DISTINCT gram FROM grams)),
known AS MATERIALIZED (SELECT unnest(all_grams) AS gram, unnest(crc32s(all_grams)) % {buckets} AS bucket FROM met)
SELECT row, bucket, count(*)::INTEGER AS n FROM (SELECT row, bucket FROM grams JOIN known USING (gram)) GROUP BY row, bucket ORDER BY row, bucket
"""


def _crcs(lists: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC of each text of each list; one call has all the grams of a slab."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    grams = lists.flatten().cast(pa.large_binary())
    offsets = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset : grams.offset + len(grams) + 1].tolist()
    data, crc = bytes(grams.buffers()[2] or b""), zlib.crc32
    found = pa.array([crc(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64())
    ends = np.concatenate([[0], np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def _engine():
    """A DuckDB connection of a task's own, with zlib's CRC as a function."""
    import duckdb

    held = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{TASK_MB}MB", "temp_directory": ""})
    held.create_function("crc32s", _crcs, ["VARCHAR[]"], "BIGINT[]", type="arrow")
    return held


def pieces(text: str, most: int = PIECE) -> list[tuple[str, bool]]:
    """A text in pieces of about `most` characters, cut between words. A piece that is not the first begins with the last word
    of the one before, so every pair of neighbours stands in one piece, and is marked: that word is not its own."""
    out, start, continued = [], 0, False
    while True:
        first = _WORD.search(text, start)
        to = first.end() + most if first else len(text)
        if to >= len(text):
            return [*out, (text[start:], continued)]
        while to < len(text) and _WORD.match(text[to]):
            # Not within a word, nor before the piece's second one has ended.
            to = _WORD.match(text, to).end()
        held = text[first.end() : to].rstrip(_GAPS)
        if not _WORD.search(held):
            # A long gap: on to the end of the next word.
            after = _WORD.search(text, to)
            if not after:
                return [*out, (text[start:], continued)]
            to = after.end()
            held = text[first.end() : to]
        out.append((text[start:to], continued))
        start, continued = first.end() + max(held.rfind(c) for c in _GAPS) + 1, True


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """docs without their texts, and buckets and counts: the buckets of all runs of one and two words, ascending, and how
    often each occurs. Null and empty texts have none."""

    def start():
        engine = _engine()
        query = FEATURES.format(buckets=buckets)

        def counted(rows: list[tuple[int, str, bool]]) -> tuple[np.ndarray, np.ndarray]:
            """(row * buckets + bucket, how often), in order unless a row has several pieces."""
            row, text, continued = zip(*rows, strict=True)
            slab = pa.table({"row": pa.array(np.arange(len(row), dtype=np.int32)), "text": pa.array(text, pa.string()), "continued": pa.array(continued)})
            engine.register("slab", slab)
            found = engine.sql(query).to_arrow_table()
            engine.unregister("slab")
            return np.array(row, np.int64)[found["row"].to_numpy()] * buckets + found["bucket"].to_numpy(), found["n"].to_numpy()

        def make(column: pa.Array) -> list[pa.Array]:
            n, parts, held, size = len(column), [], [], 0
            for i, text in enumerate(column.to_pylist()):
                for part, continued in pieces(text, piece) if len(text or "") > piece else [(text or "", False)]:
                    if held and size + len(part) > 2 * piece:
                        parts.append(counted(held))
                        held, size = [], 0
                    held.append((i, part, continued))
                    size += len(part)
            parts.append(counted(held))
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1 or len(held) > n:
                # A document's pieces meet again.
                keys, back = np.unique(keys, return_inverse=True)
                counts = np.bincount(back, counts, len(keys)).astype(np.int64)
            offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * buckets), pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys % buckets, counts)]

        return make

    kept = [c for c in docs.columns if c != "text"]
    return map_text(docs, kept, {"buckets": "array<int>", "counts": "array<int>"}, start, flat=True, slab=SLAB)


def merged(spilled: DataFrame, buckets: int) -> np.ndarray:
    """The sum of all documents' counts in each bucket. A task sends one row for each bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            # Counts in doubles are whole far beyond what a batch holds.
            total += np.bincount(at, n, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    sums = spilled.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the logarithm of its share of the target over its share of all, floored."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(spilled: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, tie, n_features and weight, the floored mean of the gains of a document's features, from its counts."""
    shared = spilled.sparkSession.sparkContext.broadcast(gain)
    kind = spilled.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())]).astype(np.int64)
            whole, parts = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (n, shared.value[at] * n))
            features, sums = (x[ends[1:]] - x[ends[:-1]] for x in (whole, parts))
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features), pa.array(weight)], names=["doc_id", "tie", "n_features", "weight"])

    return spilled.select("doc_id", "tie", "buckets", "counts").mapInArrow(weigh, f"doc_id {kind}, tie long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with their rank from 1. Ranges of the order are numbered apart, so no task holds all."""
    ranges = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row for each range.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    return ranges.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", place + F.col("_start") + 1).drop("_part", "_at", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs (doc_id, text); target (text) is what is aimed at.

    Features are all runs of one and two words, A-Z lower-cased, by CRC in buckets. weight: the floored mean of the gains of
    a document's features, 0 without any. score: weight and noise that follows from the seed and doc_id. Of the N documents
    with at least least_words words the floor(percent * N / 100) highest scores are drawn and get a rank; others' is null.

    Null and empty texts, and those without a word, have no features and are not drawn. Ties go to the smaller doc_id, of
    equal ids by their texts' hashes; repeated rows each count and may each be drawn. A null doc_id has the noise of an empty
    one and comes last of equals. An empty target has equal shares in all buckets. Further columns of either are ignored. An
    empty table gives an empty one.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    spilled = store(bucket_counts(keyed, buckets))
    aimed = store(bucket_counts(target.select("text"), buckets))
    gain = gains(merged(spilled, buckets), merged(aimed, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # n words give n features of one word and n - 1 of two.
    able = F.col("n_features") >= 2 * least_words - 1
    scored = store(_weighed(spilled, gain).withColumns({"score": F.col("weight") + noise, "able": able}))
    drop(spilled, aimed)
    drawn = scored.where("able").count() * percent // 100
    out = ranked(scored, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()])
    drop(scored)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
