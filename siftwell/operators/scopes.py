"""Structure over several lines: a file's tokens, brackets matched by running sums, scopes, and lines that belong together.

Files move once, by path; their tokens are made where they then lie, and all windows are over one file. A bracket's level is
the running sum of opening and closing ones, so at each level openings and closings take turns, and an opening's end is the
next closing of its level, whatever else is unbalanced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import structure
from siftwell.operators.ranges import containing
from siftwell.sources.corpus import split_lines

QUOTED = ("ts", "tsx", "js", "jsx")
"""Extensions whose texts stand in single quotes or backticks; elsewhere a single quote begins a character or a lifetime."""
SCOPED = ("rs", "swift", "ts", "tsx", "js", "jsx", "kt", "kts")
# Comments and texts are one token each, so what stands in them is no bracket. Then names, line ends, and single signs.
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
_TEXT = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
_CHARACTER = r"'(?:\\.|[^'\\\n])'"
_SINGLE = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
_REST = r"[A-Za-z_$][A-Za-z0-9_$]*|\n|[(){}\[\];:<>=,.!?&|@#*+-]"
TOKENS, QUOTED_TOKENS = (f"{_COMMENT}|{_TEXT}|{x}|{_REST}" for x in (_CHARACTER, _SINGLE))
# What begins a scope with a name, and what begins one without.
DECLARES = ("fn", "func", "fun", "function", "init", "deinit", "subscript", "struct", "class", "enum", "trait", "impl", "mod", "extension", "protocol", "interface", "actor", "namespace", "object", "union")
CONTROLS = ("if", "else", "for", "while", "loop", "match", "when", "switch", "guard", "do", "try", "catch", "finally", "unsafe", "defer", "repeat", "return")
FUNCTIONS = ("fn", "func", "fun", "function", "init", "deinit", "subscript")


def tokens(files: DataFrame) -> DataFrame:
    """(path, ext, i, token, line_no, level, around): the tokens of each file.

    level: how many brackets are open at the token, an opening one and its closing one included; around: the innermost of
    them, for tokens that are none. Comments and texts have served and are dropped.
    """
    cut = F.when(F.col("ext").isin(*QUOTED), F.regexp_extract_all("body", F.lit(QUOTED_TOKENS), F.lit(0))).otherwise(F.regexp_extract_all("body", F.lit(TOKENS), F.lit(0)))
    held = files.select("path", "ext", "body").repartition("path").select("path", "ext", F.posexplode(cut).alias("i", "token"))
    order = Window.partitionBy("path").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    held = held.withColumns({
        "line_no": (F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1).cast("long"),
        "_after": F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    level = F.when(closes, F.col("_after") + 1).otherwise(F.col("_after")).cast("long")
    inner = F.last(F.when(opens, F.col("token")), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("level", level).withColumn("around", F.when(~(opens | closes), inner))
    plain = ~F.col("token").rlike(r'^(/[*/]|["`\'])')
    return held.where(plain).select("path", "ext", "i", "token", "line_no", "level", "around")


def scopes(files: DataFrame) -> DataFrame:
    """(path, ext, kind, name, signature, first_line, open_line, end_line, depth): what stands in braces.

    first_line: where the statement that opens the braces begins; signature: its tokens with a space between, over however
    many lines. kind: the word that declares it, "method" or "arrow" where TypeScript has none, "block" for what has no
    name. end_line is null where a brace is never closed. depth counts braces and other brackets around.
    """
    held = tokens(files.where(F.col("ext").isin(*SCOPED)))
    order = Window.partitionBy("path").orderBy("i")
    brace = F.col("token").isin("{", "}")
    stop = brace | ((F.col("token") == ";") & (F.coalesce("around", F.lit("{")) == "{"))
    statement = F.coalesce(F.sum(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.where("token <> '\n'").withColumn("_statement", statement)
    close = F.lead(F.when(F.col("token") == "}", F.col("line_no"))).over(Window.partitionBy("path", "level", brace).orderBy("i"))
    held = held.withColumn("end_line", close)
    row = F.struct("i", "token", "line_no", "level", "end_line")
    groups = held.groupBy("path", "ext", "_statement").agg(F.max_by(row, "i").alias("o"), F.min_by("line_no", "i").alias("first_line"), F.array_sort(F.collect_list(F.struct("i", "token"))).alias("_t"))
    opened = groups.where("o.token = '{'")
    words = F.array_join(F.transform(F.slice("_t", 1, F.size("_t") - 1), lambda x: x["token"]), " ")
    named = opened.withColumn("signature", words)
    kind, name = named_by(F.col("signature"), F.col("ext"))
    return named.select("path", "ext", kind.alias("kind"), name.alias("name"), "signature", "first_line", F.col("o.line_no").alias("open_line"), F.col("o.end_line").alias("end_line"), F.col("o.level").alias("depth"))


def _last_word(signature: Column, words: tuple[str, ...]) -> Column:
    """What follows the last of these words, from the word on; empty if there is none."""
    return F.regexp_extract(signature, rf"^(?:.* )?((?:{'|'.join(words)})(?: .*)?)$", 1)


def named_by(signature: Column, ext: Column) -> tuple[Column, Column]:
    """(kind, name) of a scope by its signature's tokens."""
    declared, control = _last_word(signature, DECLARES), _last_word(signature, CONTROLS)
    word = F.regexp_extract(declared, r"^(\S+)", 1)
    of_impl = (word == "impl") & F.startswith(control, F.lit("for "))
    block = (declared == "") | (control != "") & (F.length(control) < F.length(declared)) & ~of_impl
    quoted = ext.isin(*QUOTED)
    arrow = F.regexp_extract(signature, r"^(?:.* )?(?:const|let|var) ([\w$]+) .*= >$", 1)
    method = F.regexp_extract(signature, r"^(?:.* )?([A-Za-z_$][\w$]*) (?:< [^()]*> )?\([^()]*(?:\([^()]*\)[^()]*)*\)[^()=]*$", 1)
    plain = quoted & (method != "") & ~method.isin(*CONTROLS)
    rest = F.regexp_replace(F.regexp_extract(declared, r"^\S+ ?(.*)$", 1), r"[A-Za-z_][\w]* : : ", "")
    target = F.regexp_extract(rest, r"(?:^|.* )for (?:& |mut |dyn )*([A-Za-z_]\w*)", 1)
    bare = F.regexp_extract(F.regexp_replace(rest, r"^< [^{]*?> ([A-Za-z_])", "$1"), r"^([A-Za-z_$][\w$]*)", 1)
    own = F.when((word == "impl") & (target != ""), target).when(word.isin("init", "deinit", "subscript"), word).otherwise(bare)
    kind = F.when(~block, word).when(quoted & (arrow != ""), "arrow").when(plain, "method").otherwise("block")
    name = F.when(~block, own).when(quoted & (arrow != ""), arrow).when(plain, method)
    return kind, F.nullif(name, F.lit(""))


def joined_lines(files: DataFrame) -> DataFrame:
    """(path, ext, first, last, text, lines): runs of lines that belong together, because a round or square bracket, or the
    braces of an import or export list, stay open at a line's end. text: the lines trimmed, a space between, the first one's indentation kept. Single lines are
    left out."""
    held = tokens(files.where(F.col("ext").isin(*SCOPED)))
    order = Window.partitionBy("path").orderBy("i")
    held = held.withColumn("_before", F.coalesce(F.lag("token").over(order), F.lit("")))
    held = held.withColumn("_list", F.last(F.when(F.col("token") == "{", F.col("_before").isin("export", "import", "type")), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    goes_on = F.col("around").isin("(", "[") | (F.col("around") == "{") & F.coalesce("_list", F.lit(False))
    # The line after a line end goes on if a bracket is still open there.
    marks = held.where("token = '\n'").where(goes_on).select("path", F.col("line_no").cast("int").alias("n")).groupBy("path").agg(F.array_sort(F.collect_list("n")).alias("on"))
    rows = files.join(marks, "path").select("path", "ext", split_lines(F.col("body")).alias("all"), "on")
    # A run begins at a line that goes on and whose predecessor does not, and ends with the first that does not.
    begins = F.filter("on", lambda n: ~F.array_contains("on", n - 1))
    runs = rows.select("path", "ext", "all", "on", F.explode(begins).alias("first"))
    last = F.array_min(F.filter("on", lambda n: (n >= F.col("first")) & ~F.array_contains("on", n + 1))) + 1
    runs = runs.withColumn("last", F.least(last, F.size("all"))).withColumn("lines", F.slice("all", F.col("first"), F.col("last") - F.col("first") + 1))
    return runs.select("path", "ext", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.array_join(F.transform("lines", lambda x, i: F.when(i == 0, F.rtrim(x)).otherwise(F.trim(x))), " ").alias("text"), "lines")


def broken_matches(files: DataFrame, symbol: str, languages: list[str]) -> DataFrame:
    """(language, rule, path, line_no): lines with the symbol that a rule matches only with the lines they belong to."""
    held = joined_lines(files.where(F.contains("body", F.lit(symbol))))
    found = structure.rule_matches(held.select("path", "ext", F.col("first").alias("line_no"), F.col("text").alias("line")), symbol, languages)
    whole = structure.rule_pattern("{s}", symbol)
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(whole)), F.col("first") + i)), lambda n: n.isNotNull())
    places = held.select("path", F.col("first").alias("line_no"), at.alias("at"))
    return found.join(places, ["path", "line_no"]).select("language", "rule", "path", F.explode("at").alias("line_no"))


def all_matches(files: DataFrame, lines: DataFrame, symbol: str, languages: list[str]) -> DataFrame:
    """Rule matches on lines and over lines, each once."""
    return structure.rule_matches(lines, symbol, languages).union(broken_matches(files, symbol, languages)).distinct()


def innermost(hits: DataFrame, found: DataFrame) -> DataFrame:
    """hits (path, line_no, ...) with scope_kind, scope_name, scope_start, scope_end: the innermost named scope around each; null without one."""
    last = F.lit((1 << 31) - 1).cast("long")
    ranges = found.where("kind <> 'block'").select("path", F.col("first_line").alias("start"), F.col("end_line").alias("closed"), "kind", "name", "depth")
    # Bins follow a range's length, so one that is never closed ends where its file does.
    ends = hits.groupBy("path").agg(F.max("line_no").alias("_last"))
    ranges = ranges.join(ends, "path").withColumn("end", F.least(F.coalesce("closed", last), F.col("_last"))).where("start <= end")
    keys = hits.select("path", "line_no").distinct()
    met = containing(keys, ranges.drop("_last"))
    inner = met.groupBy("path", "line_no").agg(F.max_by(F.struct("kind", "name", "start", "closed"), F.struct("depth", "start")).alias("s"))
    return hits.join(inner, ["path", "line_no"], "left").select(*hits.columns, F.col("s.kind").alias("scope_kind"), F.col("s.name").alias("scope_name"), F.col("s.start").alias("scope_start"), F.col("s.closed").alias("scope_end"))
