"""Staged search over lines: candidates, probes, scores, ranks, metrics, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.corpus import LANGUAGES, lines_of, split_lines

LONG_LINE = 200
"""A snippet of this many characters counts as cut."""
MAX_BODY = 512 * 1024
# Score of a probe's hits, and what is added.
ORIGINS = {"rg-scoped": (1.0, 0.0), "rg-global": (1.0, -0.05), "rg-indexed": (1.0, 0.1), "rga": (0.9, -0.1)}
CANDIDATE_BONUS, STRUCTURE_BONUS = 0.2, 0.5


def round_two(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)).cast("double") / 100


def language_of(ext: Column) -> Column:
    known = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    return F.try_element_at(known, F.lower(ext))


def origin_label(origin: Column, language: Column) -> Column:
    return F.when(language.isNull(), origin).otherwise(F.concat(origin, F.lit(" ["), language, F.lit("]")))


# Probes


def probe(files: DataFrame, symbol: str, ignore_case: bool = False) -> DataFrame:
    """Lines that hold the symbol: (path, ext, line_no, line). All variants of a symbol hold it, so one test does for all."""
    if not ignore_case:
        return lines_of(files, symbol).where(F.contains("line", F.lit(symbol)))
    low = symbol.lower()
    held = files.where(F.contains(F.lower("body"), F.lit(low)))
    return lines_of(held).where(F.contains(F.lower("line"), F.lit(low)))


def capped_probe(files: DataFrame, symbol: str, most: int, ignore_case: bool = False) -> DataFrame:
    """As probe, the first `most` lines of each file. A file is one row, so its lines are tested and cut there."""
    def held(x: Column) -> Column:
        return F.contains(F.lower(x) if ignore_case else x, F.lit(symbol.lower() if ignore_case else symbol))

    numbered = F.transform(split_lines(F.col("body")), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))
    found = F.slice(F.filter(numbered, lambda x: held(x["line"])), 1, most)
    return files.where(held(F.col("body"))).select("path", "ext", F.inline(found))


def scoped(files: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """The files among the first `most` candidates: by source and place where the candidates have them, else by path."""
    order = ["src_rank", "pos", "path"] if "src_rank" in candidates.columns else ["path"]
    first = candidates.orderBy(*order).limit(most).select("path")
    return files.join(first, "path", "left_semi")


def as_hits(lines: DataFrame, origin: str) -> DataFrame:
    """(path, ext, line_no, snippet, snippet_length, truncated, origin, score); the length counts the line's end."""
    length = (F.length("line") + 1).cast("long")
    base = ORIGINS[origin][0]
    return lines.select("path", "ext", "line_no", F.col("line").alias("snippet"), length.alias("snippet_length"), (length >= LONG_LINE).alias("truncated"), F.lit(origin).alias("origin"), F.lit(base).alias("score"))


# Candidates


def by_name(files: DataFrame, needle: str, most: int = 200) -> DataFrame:
    """Files whose name matches a regular expression, at most `most` in path order."""
    return files.where(F.rlike("name", F.lit(needle))).select("path").orderBy("path").limit(most)


def top_directories(scores: DataFrame, most: int = 3) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "dir").limit(most)


def directory_entries(files: DataFrame, directories: DataFrame, most: int = 5) -> DataFrame:
    """The first entries of each directory that are not hidden: (dir, pos, path)."""
    order = Window.partitionBy("dir").orderBy("name")
    listed = files.join(directories.select("dir"), "dir", "left_semi").withColumn("pos", F.row_number().over(order).cast("long"))
    return listed.where((F.col("pos") <= most) & ~F.startswith("name", F.lit("."))).select("dir", "pos", "path")


def swift_layout(files: DataFrame, children: int = 20, grandchildren: int = 10) -> DataFrame:
    """Package.swift and, below a Sources directory, the first files and the first files of each first directory: (path, level).

    A directory's first files are kept before anything is gathered by Sources directory, so what meets there is at most
    `grandchildren` files of each of its children, and of these only the first children's.
    """
    parts = F.split("path", "/")
    lead = F.get(parts, F.lit(0))
    package = files.where("path = 'Package.swift'").select("path", F.lit(0).cast("long").alias("level"))
    inside = files.where((F.lower(lead) == "sources") & (F.size(parts) <= 3)).select("path", lead.alias("_lead"), F.get(parts, F.lit(1)).alias("_child"))
    first = inside.withColumn("_g", F.row_number().over(Window.partitionBy("_lead", "_child").orderBy("path"))).where(F.col("_g") <= grandchildren)
    listed = first.select("_lead", "_child").distinct().withColumn("_c", F.row_number().over(Window.partitionBy("_lead").orderBy("_child"))).where(F.col("_c") <= children)
    kept = first.join(listed, ["_lead", "_child"])
    return package.union(kept.select("path", (F.size(parts) - 1).cast("long").alias("level")))


def ordered_union(*sources: DataFrame) -> DataFrame:
    """(path, src_rank, pos): each path once, from the first source that has it, at its first place there."""
    whole = None
    for rank, source in enumerate(sources):
        part = source.select("path", F.lit(rank).cast("long").alias("src_rank"), F.col("pos").cast("long").alias("pos"))
        whole = part if whole is None else whole.union(part)
    best = whole.groupBy("path").agg(F.min(F.struct("src_rank", "pos")).alias("b"))
    return best.select("path", "b.src_rank", "b.pos")


# Scores


def score(hits: DataFrame, candidates: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """Scores after what the origin, being a candidate file and being a structural match add. Structural matches change origin."""
    added = F.lit(0.0)
    for origin, (_, plus) in ORIGINS.items():
        added = F.when(F.col("origin") == origin, F.lit(plus)).otherwise(added)
    out = hits.withColumn("score", F.col("score") + added)
    if candidates is not None:
        flagged = candidates.select("path").distinct().withColumn("_c", F.lit(True))
        out = out.join(flagged, "path", "left").withColumn("score", F.col("score") + F.when(F.col("_c"), CANDIDATE_BONUS).otherwise(0.0)).drop("_c")
    if structure is not None:
        flagged = structure.select("path", "line_no").distinct().withColumn("_s", F.lit(True))
        out = out.join(flagged, ["path", "line_no"], "left")
        out = out.withColumn("score", F.col("score") + F.when(F.col("_s"), STRUCTURE_BONUS).otherwise(0.0)).withColumn("origin", F.when(F.col("_s"), F.lit("ast-grep")).otherwise(F.col("origin"))).drop("_s")
    return out


def best_per_line(hits: DataFrame) -> DataFrame:
    """The hit with the highest score of each (path, line_no); of equal ones the one of the earlier stage."""
    rest = [c for c in hits.columns if c not in ("path", "line_no", "stage")]
    top = hits.groupBy("path", "line_no").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("stage"))).alias("h"))
    return top.select("path", "line_no", "h.*")


def unseen(hits: DataFrame, seen: DataFrame) -> DataFrame:
    return hits.join(seen.select("path", "line_no"), ["path", "line_no"], "left_anti")


def top_hits(hits: DataFrame, most: int = 5) -> DataFrame:
    """The best hits with their rank. Only `most` rows meet in the last step."""
    order = [F.col("score").desc(), F.col("path"), F.col("line_no")]
    best = hits.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_stage(hits: DataFrame) -> DataFrame:
    """Hits of the first stage that has any: what running stage by stage until one finds something gives."""
    first = hits.agg(F.min("stage").alias("first"))
    return hits.join(F.broadcast(first), F.col("stage") == F.col("first")).drop("first")


def next_actions(top: DataFrame) -> DataFrame:
    return top.select("rank", F.concat(F.lit("inspect "), F.col("path"), F.lit(":"), F.col("line_no").cast("string")).alias("action"))


def metrics(hits: DataFrame, n_structure: Column, n_candidates: Column) -> DataFrame:
    """One row: precision, density, clustering, reward. The columns given are totals that stand in every row or literals."""
    base = hits.agg(
        F.count("*").alias("n"), F.countDistinct("path").alias("files"), (F.max("line_no") - F.min("line_no")).alias("span"),
        F.max(n_structure).alias("s"), F.max(n_candidates).alias("c"),
    )
    n = F.col("n").cast("double")
    d = n / F.greatest(F.col("files"), F.lit(1))
    none = F.col("n") == 0
    precision = F.when(none, 0.0).otherwise(F.coalesce(F.col("s"), F.lit(0)) / F.greatest(n, F.lit(1.0)))
    density = F.when(none, 0.0).otherwise(d / (d + 1))
    clustering = F.when(none, 0.0).otherwise(1 / (1 + F.coalesce(F.col("span"), F.lit(0)) / (n + 1)))
    bonus = F.when(none | (F.coalesce(F.col("c"), F.lit(0)) == 0), 0.0).otherwise(F.least(n, F.col("c").cast("double")) / F.greatest(F.col("c"), F.lit(1)))
    m = base.select(precision.alias("precision"), density.alias("density"), clustering.alias("clustering"), bonus.alias("bonus"))
    reward = 0.5 * F.col("precision") + 0.3 * F.col("density") + 0.15 * F.col("clustering") + 0.05 * F.col("bonus")
    return m.select(*(round_two(F.col(c)).alias(c) for c in ("precision", "density", "clustering")), round_two(reward).alias("reward"))


# Context


def padding(before: int, after: int, truncated: Column) -> tuple[Column, Column, Column]:
    """(before, after, auto): nothing asked for gives 2 and 2, a cut snippet at least 4 on both sides."""
    none = before == 0 and after == 0
    b, a = (2, 2) if none else (before, after)
    wide_b, wide_a = max(b, 4), max(a, 4)
    auto = F.lit(none) | (truncated & F.lit((wide_b, wide_a) != (b, a)))
    return F.when(truncated, F.lit(wide_b)).otherwise(F.lit(b)), F.when(truncated, F.lit(wide_a)).otherwise(F.lit(a)), auto


def with_context(top: DataFrame, files: DataFrame, before: int = 0, after: int = 0, max_body: int = MAX_BODY, want_body: bool = False) -> DataFrame:
    """Window of lines and body for each hit of top, a bounded number of rows.

    The hits' paths go to the files first and leave of them only their own, so no other file's body is sent or broadcast.
    """
    b, a, auto = padding(before, after, F.col("truncated"))
    bodies = files.join(F.broadcast(top.select("path").distinct()), "path", "left_semi").select("path", "body", "n_bytes")
    held = top.join(bodies.hint("shuffle_hash"), "path", "left").withColumn("_lines", split_lines(F.col("body")))
    n = F.size("_lines")
    start = F.greatest(F.lit(1), F.col("line_no") - b)
    end = F.least(n.cast("long"), F.col("line_no") + a)
    width = F.length(end.cast("string"))
    window = F.slice("_lines", start.cast("int"), (end - start + 1).cast("int"))
    numbered = F.transform(window, lambda x, i: F.concat(F.lpad((start + i).cast("string"), width, F.lit("0")), F.lit(" "), x))
    asked = F.lit(want_body) | F.col("ext").isin("rs", "swift")
    body = F.when(asked & (F.col("n_bytes") <= max_body), F.col("body"))
    return held.select(
        *top.columns, start.cast("long").alias("context_start"), end.cast("long").alias("context_end"), auto.alias("auto"),
        F.concat(F.array_join(numbered, "\n"), F.lit("\n")).alias("expanded_snippet"), body.alias("body"), body.isNotNull().alias("body_retrieved"),
    )


# Stages and languages


def language_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.coalesce(language_of(F.col("ext")), F.lit("other")).alias("language")).agg(F.count("*").alias("n"))


def language_metrics(staged: DataFrame, stages: list[str]) -> DataFrame:
    """One row for each language with a count for each stage."""
    language = F.coalesce(language_of(F.col("ext")), F.lit("other")).alias("language")
    return staged.groupBy(language).agg(*(F.count(F.when(F.col("stage") == s, 1)).alias(f"n_{s}") for s in stages))


def distribute(total: Column, keys: DataFrame, key: str) -> DataFrame:
    """A whole number dealt evenly over keys, one more to each of the first by key. keys: a bounded table."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(key))
    return keys.select(key, (F.floor(total / n) + F.when(rank <= F.pmod(total, n), 1).otherwise(0)).cast("long").alias("share_ms"))
