"""Quality rules: per-document counts, and a log-likelihood ratio of hashed n-grams between trusted and all text.

DataFrame functions only. Words and word pairs fall into a fixed number of classes by hash, so the table of ratios that is
broadcast has the same size at any input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import SPACE, store

CLASSES = 1 << 16
"""Hash classes of n-grams: two columns of this many rows are broadcast, about 1 MB."""
PRIOR = 2
"""Added to each class's count."""
THRESHOLD = -0.14
"""Least mean shrunk log-likelihood ratio of a kept document."""


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, not once for each element that refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    def filled(parts: Column) -> Column:
        # Separators are whole runs, so only the first and the last piece can be empty.
        first, last = F.get(parts, F.lit(0)) == "", F.get(parts, F.size(parts) - 1) == ""
        n = F.size(parts) - first.cast("int") - last.cast("int")
        return F.slice(parts, first.cast("int") + 1, F.greatest(n, F.lit(0)))

    return _let(F.split(F.coalesce(text, F.lit("")), SPACE), filled)


def repeat_words(words: Column) -> Column:
    """How many words lie in a run of three words that occurs twice or more in the text, the first occurrence included."""

    def places(grams: Column) -> Column:
        """Runs that occur again: neighbours in sorted order with the same hash."""

        def same(s: Column) -> Column:
            def again(g: Column, i: Column) -> Column:
                return F.coalesce(F.get(s, i - 1)["h"] == g["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == g["h"], F.lit(False))

            return F.filter(s, again)

        return _let(F.sort_array(grams), same)

    def hashes(w: Column) -> Column:
        def joined(a: Column, b: Column) -> Column:
            return F.slice(F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)), F.lit(1), F.size(w) - 2)

        pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.xxhash64(x, y))
        return joined(pairs, F.slice(w, F.lit(3), F.size(w)))

    def covered(h: Column) -> Column:
        again = places(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda g: F.array(g["at"], g["at"] + 1, g["at"] + 2)))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(F.transform(words, lambda x: F.xxhash64(x)), hashes), counted)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """docs with words (array) and the five base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return docs.withColumn("_words", words_of(F.col("text"))).select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )


def classes(words: Column) -> Column:
    """The classes of a text's words, then those of its pairs of neighbouring words."""

    def of(h: Column) -> Column:
        return h.bitwiseAND(F.lit(CLASSES - 1)).cast("int")

    def all_of(w: Column) -> Column:
        ones = F.transform(w, lambda a: of(F.xxhash64(a)))
        twos = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: of(F.xxhash64(F.lit(2), a, b)))
        # The last word has no next one: its pair is left out.
        return F.when(F.size(w) < 2, ones).otherwise(F.concat(ones, F.slice(twos, F.lit(1), F.size(w) - 1)))

    return _let(words, all_of)


UNIT = 1_000_000
"""Ratios are whole numbers of millionths, so their sums don't depend on the order."""


def ratios(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(gram, ratio, shrunk) in UNITs. ratio: log of the class's share in trusted text over its share in all text, PRIOR
    added to each count. shrunk: log of its count in trusted text over the count that its share in all text lets expect
    there, PRIOR added to both. That pulls towards the shares of all text, to 0 for an empty target, where ratio is pulled
    towards equal shares. One occurrence, the one that is scored, is left out of all text: else a class that few documents
    hold would count against each of them. Both counts come from one pass."""
    # Trusted ids grow with the corpus, so they are merged at every size and never broadcast.
    ids = trusted_ids.select("doc_id", F.lit(1).alias("_trusted")).distinct()
    marked = docs.join(ids.hint("merge"), "doc_id", "left")
    grams = marked.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.explode(classes(words_of(F.col("text")))).alias("gram"))
    both = store(grams.groupBy("gram").agg(F.sum("_trusted").alias("target"), F.count("*").alias("raw")))
    all_target, all_raw = both.agg(F.sum("target"), F.sum("raw")).first()
    share_t = (F.col("target") + PRIOR) / F.lit((all_target or 0) + PRIOR * CLASSES)
    share_r = (F.col("raw") - 1 + PRIOR) / F.lit((all_raw or 0) + PRIOR * CLASSES)
    expected = (F.col("raw") - 1) * F.lit((all_target or 0) / max((all_raw or 0) - 1, 1))

    def units(x: Column) -> Column:
        return F.round(F.log(x) * UNIT).cast("long")

    return both.select("gram", units(share_t / share_r).alias("ratio"), units((F.col("target") + PRIOR) / (expected + PRIOR)).alias("shrunk"))


def as_array(table: DataFrame, value: str) -> Column:
    """A column of ratios as one array with a place for each class, the same for all rows: CLASSES numbers, whatever the input."""
    every = table.sparkSession.range(CLASSES).withColumn("gram", F.col("id").cast("int")).join(table, "gram", "left")
    ordered = F.array_sort(F.collect_list(F.struct("gram", F.coalesce(value, F.lit(0)).alias("v"))))
    return every.agg(F.transform(ordered, lambda x: x["v"]).alias("all")).scalar()


def mean_ratios(words: Column, *tables: Column) -> Column:
    """An array with the mean of each table's ratios over the words and word pairs of a text; 0 without words. No row leaves
    its place, and the classes are made once."""

    def over(c: Column) -> Column:
        def mean(t: Column) -> Column:
            return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.get(t, x)) / F.greatest(F.size(c), F.lit(1)) / UNIT

        return F.array(*(_let(t, mean) for t in tables))

    return _let(classes(words), over)


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr for each row of docs.

    trusted_ids (doc_id): documents that stand for the target. A document is kept if the base rules pass and the mean of
    its grams' shrunk ratios is at least threshold; llr is the mean of the plain ones. Null and empty texts: zero counts,
    base_failed, not kept, llr 0. Repeated rows each come back. Without trusted documents all shrunk ratios are 0, so only
    base rules decide.
    Extra columns are ignored; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    table = ratios(docs, trusted_ids)
    rows = measures(docs).withColumns({"_plain": as_array(table, "ratio"), "_shrunk": as_array(table, "shrunk")})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("_means", mean_ratios(F.col("_words"), F.col("_plain"), F.col("_shrunk")))
    good = F.get("_means", F.lit(1)) >= threshold
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"),
        F.round(F.get("_means", F.lit(0)), 6).alias("llr"),
    )
