"""Licence scans by diagonal voting.

Hashes of all rolling word pairs and triples of all documents are joined to the positions at which licence templates hold
them. A hit votes for a diagonal: its place in the text less its place in the template. Votes of neighbouring diagonals are
merged where one goes on after the other in text and template, so a few words more or less don't break a span, and the
diagonal with most votes of those merged stands for them. The words of each span are then verified: base phrases must stand
word for word, notices by edit distance and by the words that tell licences apart. Where spans of several templates overlap,
the best one stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.flat import LETTERS, FlatWords, lists, runs, within
from siftwell.llm.license_texts import NOTICES
from siftwell.llm.rules import _let
from siftwell.llm.shared import map_text, store

PAIR, TRIPLE = 2, 3
"""Words of the rolling hashes: pairs vote for base phrases, triples for notices."""
DRIFT = 5
"""Diagonals of one template this near to each other vote together."""
VOTES = 0.3
"""Least part of a notice's triples that must vote for a span before its words are verified."""
COVER = 0.8
"""Least likeness of a span's words to the notice's: 1 less the edit distance over the notice's length."""
TELLING = ("nc", "sa", "nd", "sharealike", "noncommercial", "noderivatives", "lesser", "affero")
"""Fixed values: words that change what a licence is. A span must hold those of its notice, in order, and no others; so
with whole numbers where the notice has any."""

# Fixed phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text: str) -> str:
    """A template's words, lower-cased, with one space between."""
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


def telling(words: list[str], numbers: bool) -> str:
    return " ".join(w for w in words if w in TELLING or numbers and w.isdigit())


TEMPLATES: list[tuple[str, str, bool]] = [*((p, label, True) for p, label in BASE.items()), *((plain(t), label, False) for t, label in NOTICES.items())]
"""(words, label, base) of each template."""


def _hashes(phrase: str, k: int) -> list[int]:
    """The rolling hashes of a phrase, as documents' are made."""
    h, ends, _, _ = FlatWords(LETTERS)(pa.array([phrase]))
    return runs(h, k)[within(ends, k)[0]].view(np.int64).tolist()


def rolled(docs: DataFrame, known: list[int]) -> DataFrame:
    """_row, doc_id, n_words, rolling and held for each document.

    rolling: 0, then the hashes of all word pairs, then of all word triples. held: the words, lower-cased, of texts with
    one of the known hashes at least; what joins no template needs no verification later.
    """
    wanted = np.array(sorted(known), np.int64)

    def start():
        words = FlatWords(LETTERS)

        def make(column: pa.Array) -> list[pa.Array]:
            h, ends, kept, texts = words(column)
            n = np.diff(ends)
            pair_at, pairs = within(ends, PAIR)
            triple_at, triples = within(ends, TRIPLE)
            sizes = 1 + pairs + triples
            heads = np.cumsum(sizes) - sizes
            flat = np.zeros(int(sizes.sum()), np.int64)
            flat[np.arange(len(pair_at)) + np.repeat(heads + 1 - (np.cumsum(pairs) - pairs), pairs)] = runs(h, PAIR)[pair_at].view(np.int64)
            flat[np.arange(len(triple_at)) + np.repeat(heads + 1 + pairs - (np.cumsum(triples) - triples), triples)] = runs(h, TRIPLE)[triple_at].view(np.int64)
            near = wanted[np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)] == flat
            some = np.add.reduceat(near, heads) > 0 if len(heads) else near
            held = [b" ".join(np.where(LETTERS.inside[x], x, 32).astype(np.uint8).tobytes().split()).decode("utf-8", "replace") if hit else None for hit, x in zip(some, np.split(kept, texts[1:-1]), strict=True)]
            return [pa.array(n, pa.int64()), lists(flat, sizes, pa.int64()), pa.array(held, pa.string())]

        return make

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    made = map_text(numbered, ["_row", "doc_id"], {"n_words": "long", "rolling": "array<long>", "held": "string"}, start, flat=True, slab=1000)
    return made


def _in_ascii(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]", "?")


def license_spans(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: _row, doc_id, n_words of each document. spans: _row, template (place in templates), label, base,
    start, end (words from 0), cover. All places of base phrases are spans; of notices those that no better one overlaps.
    """
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    places = []
    for t, (phrase, _, base) in enumerate(templates):
        k = PAIR if base else TRIPLE
        hashes = _hashes(phrase, k)
        places += [(h, t, i, len(hashes), k, base) for i, h in enumerate(hashes)]
    grams = spark.createDataFrame(places, "h long, template int, tpos int, size int, k int, base boolean")
    rolling = rolled(docs, [p[0] for p in places]).select("*", F.posexplode("rolling").alias("_p", "_h"))
    head = F.col("_p") == 0
    met = rolling.join(F.broadcast(grams), F.col("_h") == F.col("h"), "left").where(head | F.col("template").isNotNull())
    n_pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    pos = F.col("_p") - 1 - F.when(F.col("k") == TRIPLE, n_pairs).otherwise(F.lit(0))
    # One pass over the texts: each document's own row and its hits are written once, and all that follows reads them.
    met = store(met.select("_row", head.alias("head"), *(F.when(head, F.col(c)).alias(c) for c in ("doc_id", "n_words", "held")), "template", "base", "k", "size", pos.alias("pos"), "tpos"))
    rows = met.where("head").select("_row", "doc_id", "n_words", "held")
    hits = met.where("NOT head")

    votes = hits.groupBy("_row", "template", "base", "k", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    exact = votes.where("base AND votes = size").select("_row", "template", "base", F.col("diagonal").alias("start"), (F.col("hi") + F.col("k")).alias("end"))
    near = Window.partitionBy("_row", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    around = votes.where("NOT base").withColumn("near", F.collect_list(F.struct("diagonal", "votes", "lo", "hi")).over(near))
    # Of the diagonals around one, those belong to it that go on where it ends, in the text and in the template: a notice that
    # follows itself votes for the same places of the template again, and is a peak of its own.
    first, last = F.col("lo") - F.col("diagonal"), F.col("hi") - F.col("diagonal")
    before = lambda x: (x["hi"] < F.col("lo")) & (x["hi"] - x["diagonal"] < first)
    after = lambda x: (x["lo"] > F.col("hi")) & (x["lo"] - x["diagonal"] > last)
    around = around.withColumn("near", F.filter("near", lambda x: before(x) | after(x)))
    best = ~F.exists("near", lambda x: (x["votes"] > F.col("votes")) | (x["votes"] == F.col("votes")) & (x["diagonal"] < F.col("diagonal")))
    every = F.aggregate("near", F.col("votes"), lambda n, x: n + x["votes"])
    start = F.array_min(F.concat(F.array("lo"), F.transform("near", lambda x: x["lo"])))
    end = F.array_max(F.concat(F.array("hi"), F.transform("near", lambda x: x["hi"])))
    peaks = around.where(best & (every >= VOTES * F.col("size"))).select("_row", "template", "base", start.alias("start"), (end + F.col("k")).alias("end")).distinct()

    asked = exact.union(peaks).groupBy("_row").agg(F.collect_list(F.struct("template", "base", "start", "end")).alias("asked"))
    phrase, label = (F.array(*(F.lit(t[i]) for t in templates)) for i in (0, 1))
    tells = F.array(*(F.lit(telling(p.split(), any(w.isdigit() for w in p.split()))) for p, _, _ in templates))
    counts = F.array(*(F.lit(any(w.isdigit() for w in p.split())) for p, _, _ in templates))

    def read(words: Column) -> Column:
        return F.transform(F.col("asked"), lambda s: F.struct(s["template"], s["base"], s["start"], s["end"], F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("words")))

    read_out = rows.join(asked, "_row").select("_row", F.inline(_let(F.split("held", " "), read)))
    in_span = F.filter("words", lambda w: w.isin(*TELLING) | (F.get(counts, F.col("template")) & w.rlike("^[0-9]+$")))
    wanted = F.get(phrase, F.col("template"))
    distance = F.levenshtein(_in_ascii(F.array_join("words", " ")), wanted)
    cover = F.when(F.col("base"), (F.array_join("words", " ") == wanted).cast("double")).otherwise(1 - distance / F.length(wanted))
    told = F.col("base") | (F.array_join(in_span, " ") == F.get(tells, F.col("template")))
    good = read_out.where(told).select("_row", "template", F.get(label, F.col("template")).alias("label"), "base", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), cover.alias("cover"))
    good = good.where(F.when(F.col("base"), F.col("cover") == 1).otherwise(F.col("cover") >= COVER))

    reach = max(len(p.split()) for p, _, _ in templates) * 2 + 2 * DRIFT
    others = Window.partitionBy("_row").orderBy("start").rangeBetween(-reach, reach)
    merit = F.struct("cover", (F.col("end") - F.col("start")).alias("size"), (-F.col("template")).alias("early"))
    ranked = good.where("NOT base").withColumn("merit", merit).withColumn("others", F.collect_list(F.struct("start", "end", "merit")).over(others))
    beaten = F.exists("others", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"]) & (o["merit"] > F.col("merit")))
    spans = good.where("base").union(ranked.where(~beaten).select(*good.columns))
    return rows.drop("held"), spans


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: n_words, places of the base phrases, labels of base and of all spans, and the best cover as score.

    Null and empty texts have no word, place or label and score 0. Repeated rows each come back with equal results, a null
    doc_id is no obstacle. Extra columns are ignored; an empty table gives an empty one.
    """
    rows, spans = license_spans(docs.select("doc_id", "text"))
    base = F.col("base")
    found = spans.groupBy("_row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    none = F.lit("")
    return rows.join(found, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
