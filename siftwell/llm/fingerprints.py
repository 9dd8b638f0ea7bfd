"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

DataFrame functions only. Sketches of two texts merge by union, and shares of common hashes estimate likeness and
containment even when one text is far longer, since both keep the same part of the hash range.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.rules import _let, words_of

WORDS = 5
SHARE = 1 / 8
"""Part of the hash range that is kept."""
ROWS = 1000
"""Documents of one id range; ranges are windows' partitions."""
COARSE, MOST_RANGES = 64, 20_000
"""Quantiles within which quantiles are taken, and most ranges in all: the table of their first rows is broadcast. Of more
documents than ROWS times that a range holds more than ROWS; its window sorts, so it may spill, and needs no more memory."""


def sketch(text: Column, k: int = WORDS, share: float = SHARE) -> Column:
    """Sorted distinct hashes of the text's runs of k words that lie below share of the range.

    A text with fewer words has one run, all of them. A text with words keeps at least its smallest hash, so short texts
    compare too; that one is also kept under union. Without words: an empty array.
    """
    least = -(1 << 63)
    limit = least + int(share * (1 << 64))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < limit)
        return F.sort_array(F.when(F.size(low) > 0, F.array_distinct(low)).otherwise(F.array(F.array_min(h))))

    def whole(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_let(runs(w), kept))

    return _let(F.transform(words_of(text), lambda x: F.xxhash64(x)), whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds: 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


def _ranges(docs: DataFrame, rows: int) -> tuple[list[tuple], list[int], int, int]:
    """Ranges of ids by descending id, of about equally many documents each: ((coarse, above, top, part, slots) of each,
    the coarse ranges' tops, the part of null ids, and its slots).

    Cuts are quantiles of quantiles, so at most MOST_RANGES numbers reach the driver. An id at which several cuts fall has
    many documents: it is a range of its own, with as many slots, into which its documents go by their texts' hashes.
    """
    coarse_at = [i / COARSE for i in range(1, COARSE)]
    total, known, low, high, cuts = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", coarse_at, 10_000)).first()
    per = max(rows, -(-total // MOST_RANGES))
    if not known:
        return [], [0], 0, max(1, total // per)
    edges = sorted({high, *(c for c in cuts if c < high)}, reverse=True)
    fine = max(1, min(MOST_RANGES // COARSE, -(-total // per)))
    fine_at = [i / fine for i in range(1, fine + 1)]
    held = docs.where("doc_id IS NOT NULL").select("doc_id", _coarse(edges).alias("c")).groupBy("c").agg(F.percentile_approx("doc_id", fine_at, 10_000).alias("cuts"), F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()
    ranges, part = [], 0
    for r in sorted(held, key=lambda r: r["c"]):
        wanted = max(1, min(fine, r["n"] // per))
        tops = Counter(r["cuts"][-(-i * fine // wanted) - 1] for i in range(1, wanted + 1))
        tops.setdefault(r["top"], 1)
        order = sorted(tops, reverse=True)
        for top, below in zip(order, [*order[1:], edges[r["c"] + 1] if r["c"] + 1 < len(edges) else low - 1], strict=True):
            # So many rows have this id, by the fine cuts that fall on it.
            slots = max(1, r["cuts"].count(top) * r["n"] // (fine * per))
            hot = slots > 1
            for above, most, n in ([(top - 1, top, slots)] if hot else []) + ([(below, top - hot, 1)] if top - hot > below else []):
                ranges.append((r["c"], above, most, part, n))
                part += n
    return ranges, edges, part, max(1, (total - known) // per)


def _coarse(edges: list[int]) -> Column:
    """Which of the descending edges an id lies at or below, the last such."""
    known = F.array(*map(F.lit, edges))
    return F.size(F.filter(known, lambda e: e >= F.col("doc_id"))) - 1


def with_next(docs: DataFrame, make: dict[str, Column], rows: int | None = None) -> DataFrame:
    """(doc_id, text, made columns) and next_* of each for the document that follows by descending id; the first follows the last.

    Ids are cut into ranges of about `rows` documents. Each range also gets a copy of the document that heads the following range, so
    its window sees its last row's successor. Documents with one id are ordered by their texts' hashes; a null id comes last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges, edges, null_part, null_slots = _ranges(docs.select("doc_id"), rows or ROWS)
    table = F.broadcast(spark.createDataFrame(ranges, "c int, above long, top long, first long, slots long"))
    hashed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_coarse", _coarse(edges))
    inside = (F.col("_coarse") == F.col("c")) & (F.col("doc_id") > F.col("above")) & (F.col("doc_id") <= F.col("top"))
    slots = F.coalesce("slots", F.lit(null_slots))
    slot = F.least(slots - 1, F.floor((F.col("_hash").cast("double") / float(1 << 64) + 0.5) * slots))
    placed = hashed.join(table, inside, "left").select("doc_id", "text", "_hash", (F.coalesce("first", F.lit(null_part)) + slot).cast("long").alias("_part"))
    heads = placed.groupBy("_part").agg(F.max(F.struct("doc_id", F.bitwise_not("_hash").alias("h"))).alias("head")).collect()
    heads.sort(key=lambda r: r["_part"])
    tops = [(r["_part"], heads[i - 1]["_part"], r["head"]["doc_id"], ~r["head"]["h"]) for i, r in enumerate(heads)]
    tops = F.broadcast(spark.createDataFrame(tops, "p long, before long, id long, h long"))
    is_head = (F.col("_part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("h"))

    def to(where: Column, copy: bool) -> Column:
        return F.struct(where.alias("part"), F.lit(copy).alias("copy"))

    copies = F.when(F.col("before").isNull(), F.array(to(F.col("_part"), False))).otherwise(F.array(to(F.col("_part"), False), to(F.col("before"), True)))
    spread = placed.join(tops, is_head, "left").select("doc_id", "text", "_hash", F.explode(copies).alias("_c")).select("doc_id", "text", "_hash", "_c.*")
    spread = spread.select("*", *(c.alias(n) for n, c in make.items()))
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "_hash")
    seen = spread.select("*", *(F.lead(n).over(order).alias(f"next_{n}") for n in ("text", *make)))
    return seen.where(~F.col("copy")).drop("_hash", "part", "copy")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's sketch, that of its text with the last third replaced by the next document's start, and likenesses.

    Null texts count as empty. Equal texts have equal fingerprints; a text without words has the empty one. Repeated rows
    each come back; a single document follows itself. Extra columns are ignored; an empty table gives an empty one.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    seen = with_next(docs, {"print": sketch(F.col("text"))})
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = seen.withColumn("edited", edited).withColumn("edited_print", sketch(F.col("edited")))
    return made.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        containment(F.col("print"), F.col("edited_print")).alias("held_by_edited"),
    )
