"""Structural rules on lines: declarations, signatures, enclosing types, attributes, modules, each found in its file's row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.corpus import split_lines


def collapse(x: Column) -> Column:
    """Runs of Unicode white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def indentation(x: Column) -> Column:
    return (F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))).cast("long")


# What begins a declaration, a signature, a type.
RUST_DECLARES = ("fn", "struct", "enum", "trait", "type", "const", "static", "macro_rules!")
SWIFT_SIGNS = ("func", "init", "var", "let", "case", "subscript", "deinit")
SWIFT_TYPES = ("struct", "class", "enum", "protocol", "actor")


def _words(keywords: tuple[str, ...], after: str = r"[ (]") -> str:
    """A pattern: a keyword at the start or after a space, followed by a space or an opening bracket."""
    return r"(^|\s)(" + "|".join(keywords) + ")" + after


def low(line: Column) -> Column:
    return F.lower(collapse(line))


def _declares(x: Column) -> Column:
    comment = x.rlike(r"^(//|/\*|\*/|#\[|\}|$)")
    return ~comment & x.rlike(_words(RUST_DECLARES))


def _near(keyword: str, x: Column) -> Column:
    return x.rlike("^(.{0,31}[^a-z0-9_]|)" + keyword)


def is_rust_declaration(line: Column) -> Column:
    return _declares(low(line))


def near_start(keyword: str, line: Column) -> Column:
    """A keyword within the first 32 characters, not after a letter, digit or underscore."""
    return _near(keyword, low(line))


def is_rust_impl(line: Column) -> Column:
    return near_start("impl[ <(]", line)


def is_rust_module(line: Column) -> Column:
    return near_start("mod ", line) & (indentation(line) == 0)


def _signs(x: Column) -> Column:
    return ~x.rlike(r"^(//|/\*|\*/|@|\}|$)") & x.rlike(_words(SWIFT_SIGNS, r"[ ({<?]"))


def _type_kind(x: Column) -> Column:
    return F.when(x.rlike(_words(("extension",), " ")), "extension").when(x.rlike(_words(SWIFT_TYPES, " ")), "type")


def is_swift_signature(line: Column) -> Column:
    return _signs(low(line))


def swift_type_kind(line: Column) -> Column:
    return _type_kind(low(line))


# Rows here are files: (path, ext, lines), the lines an array. What stands above a line is found in its file's row, in time
# that follows the number of lines, and nothing moves.


def bound(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of values that are made once, however often f reads them inside of loops over arrays."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f), 0)


def numbers(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The numbers of the lines, from 1, that pass a test."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i + 1)), lambda n: n.isNotNull())


def at_or_above(found: Column, size: Column) -> Column:
    """For each line of a file the place, from 1, of the last of some line numbers at or above it; 0 before the first."""
    def stretch(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(1)).otherwise(F.get(found, i - 1))
        return F.array_repeat(i, (F.coalesce(F.get(found, i), size + 1) - begin).cast("int"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), stretch))


def _nth(found: Column, place: Column) -> Column:
    """The line number at a place from 1; null at 0."""
    return F.get(found, place - 1)


def with_lines(files: DataFrame) -> DataFrame:
    """Files (path, ext, body) as rows with an array of lines; files without a body have none."""
    return files.select("path", "ext", F.coalesce(split_lines(F.col("body")), F.array().cast("array<string>")).alias("lines"))


def _each_line(rows: DataFrame, made: Column) -> DataFrame:
    """(path, line_no, made.*) for an array with an element for each line."""
    return rows.select("path", F.posexplode(made).alias("_i", "_m")).select("path", (F.col("_i") + 1).cast("long").alias("line_no"), "_m.*")


def nearest_above(rows: DataFrame, test: Callable[[Column], Column], name: str, strict: bool = False) -> DataFrame:
    """(path, line_no, name_line, name_text): for each line the last one at or above (strict: above) it where test holds."""
    def whole(v: Column) -> Column:
        places = at_or_above(v["found"], F.size(v["lines"]))
        moved = F.slice(F.concat(F.array(F.lit(0)), places), 1, F.size(v["lines"])) if strict else places
        at = F.transform(moved, lambda k: _nth(v["found"], k))
        return F.transform(at, lambda n: F.struct(n.cast("long").alias(f"{name}_line"), collapse(F.get(v["lines"], n - 1)).alias(f"{name}_text")))

    return _each_line(rows, bound({"lines": F.col("lines"), "found": numbers(F.col("lines"), test)}, whole))


def _is_attribute(mark: str) -> Callable[[Column], Column]:
    return lambda x: F.startswith(F.trim(x), F.lit(mark))


def _is_solid(mark: str) -> Callable[[Column], Column]:
    """Lines that are no attribute, blank or comment."""
    return lambda x: ~(_is_attribute(mark)(x) | (F.trim(x) == "") | F.startswith(F.trim(x), F.lit("//")))


def _run_above(lines: Column, at: Column, solid: Column, mark: str) -> Column:
    """The numbers and texts of the attributes between a line and the last solid one above it."""
    begin = F.coalesce(solid, F.lit(0))
    between = F.transform(F.slice(lines, (begin + 1).cast("int"), (at - begin - 1).cast("int")), lambda x, i: F.struct((begin + 1 + i).cast("long").alias("line"), x.alias("text")))
    return F.transform(F.filter(between, lambda x: _is_attribute(mark)(x["text"])), lambda x: F.struct(x["line"], collapse(x["text"]).alias("label")))


def attributes(rows: DataFrame, mark: str) -> DataFrame:
    """(path, line_no, attribute_line, attribute): the attribute lines in the run of attributes, blanks and comments right
    above each line that is none of these itself."""
    def whole(v: Column) -> Column:
        return F.transform(v["solid"], lambda n, i: F.struct(n.cast("long").alias("line_no"), _run_above(v["lines"], n, F.when(i > 0, F.get(v["solid"], i - 1)), mark).alias("run")))

    found = rows.select("path", F.inline(bound({"lines": F.col("lines"), "solid": numbers(F.col("lines"), _is_solid(mark))}, whole)))
    return found.select("path", "line_no", F.inline("run").alias("attribute_line", "attribute"))


def last_modules(rows: DataFrame, anchors: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """(path, line_no, module_line, module): the last modules at or above each line that passes a test."""
    def whole(v: Column) -> Column:
        places = at_or_above(v["found"], F.size(v["lines"]))
        return bound({"places": places}, lambda p: F.transform(v["asked"], lambda n: F.struct(n.cast("long").alias("line_no"), _modules(v["lines"], v["found"], F.get(p["places"], n - 1), most).alias("run"))))

    held = {"lines": F.col("lines"), "found": numbers(F.col("lines"), is_rust_module), "asked": numbers(F.col("lines"), anchors)}
    return rows.select("path", F.inline(bound(held, whole))).select("path", "line_no", F.inline("run").alias("module_line", "module"))


def _modules(lines: Column, found: Column, place: Column, most: int) -> Column:
    """Of the line numbers up to a place the last ones, with their texts."""
    first = F.greatest(F.lit(1), place - (most - 1))
    kept = F.when(place > 0, F.slice(found, first.cast("int"), (place - first + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(kept, lambda n: F.struct(n.cast("long").alias("line"), collapse(F.get(lines, n - 1)).alias("label")))


# The order of hints of one line.
HINTS = {"attribute": 0, "type": 1, "extension": 1, "declaration": 2, "impl": 3, "module": 4}


def context_hints(rows: DataFrame, hits: Column) -> DataFrame:
    """(path, line_no, hints): for each hit in a Rust or Swift file what surrounds it, an array of (line, kind, label) by
    line, each once; hits without any are left out. hits: an array of line numbers for each row of rows.

    The anchor is the nearest declaration at or above the hit, else the hit. Rust: attributes above the anchor, the
    declaration, the nearest impl above the anchor, the last modules. Swift: attributes, the nearest type or extension at or
    above the anchor, the declaration.
    """
    lines = F.col("lines")
    rows = rows.where(F.col("ext").isin("rs", "swift"))
    rust = F.col("ext") == "rs"
    lows = F.transform(lines, low)
    none = F.array().cast("array<int>")

    def of(v: Column, rs: Callable[[Column], Column] | None, swift: Callable[[Column], Column] | None) -> Column:
        return F.when(rust, numbers(v, rs) if rs else none).otherwise(numbers(v, swift) if swift else none)

    solid = F.when(rust, numbers(lines, _is_solid("#["))).otherwise(numbers(lines, _is_solid("@")))
    found = bound({"lows": lows}, lambda v: F.struct(
        of(v["lows"], _declares, _signs).alias("declared"), of(v["lows"], lambda x: _near("impl[ <(]", x), None).alias("impl"), of(v["lows"], None, lambda x: _type_kind(x).isNotNull()).alias("types"),
    ))
    modules = F.when(rust, numbers(lines, is_rust_module)).otherwise(none)

    def whole(v: Column) -> Column:
        n, f = F.size(v["lines"]), v["found"]
        above = {k: at_or_above(x, n) for k, x in (("declared", f["declared"]), ("impl", f["impl"]), ("types", f["types"]), ("modules", v["modules"]), ("solid", v["solid"]))}
        return bound(above, lambda p: F.transform(v["hits"], lambda h: one(v, p, h)))

    def one(v: Column, p: Column, hit: Column) -> Column:
        f, lines = v["found"], v["lines"]
        declared = _nth(f["declared"], F.get(p["declared"], (hit - 1).cast("int")))

        def told(a: Column) -> Column:
            at = a["at"]
            before = lambda name: F.coalesce(F.get(p[name], at - 2), F.lit(0))
            here = lambda name: F.get(p[name], at - 1)
            hint = lambda n, kind: F.filter(F.array(F.struct(n.cast("long").alias("line"), F.lit(kind).alias("kind"), collapse(F.get(lines, n - 1)).alias("label"))), lambda x: x["line"].isNotNull())
            listed = lambda found, kind: F.transform(found, lambda x: F.struct(x["line"], F.lit(kind).alias("kind"), x["label"]))
            runs = F.when(rust, _run_above(lines, at, _nth(v["solid"], before("solid")), "#[")).otherwise(_run_above(lines, at, _nth(v["solid"], before("solid")), "@"))
            types = F.transform(hint(_nth(f["types"], here("types")), "type"), lambda x: F.struct(x["line"], _type_kind(F.lower(x["label"])).alias("kind"), x["label"]))
            every = F.concat(hint(a["declared"], "declaration"), listed(runs, "attribute"), hint(_nth(f["impl"], before("impl")), "impl"), listed(_modules(lines, v["modules"], here("modules"), 3), "module"), types)
            rank = F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv))
            ordered = F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: x["label"] != ""), lambda x: F.struct(x["line"], F.element_at(rank, x["kind"]).alias("o"), x["kind"], x["label"]))))
            return F.struct(hit.cast("long").alias("line_no"), F.transform(ordered, lambda x: F.struct(x["line"].alias("line"), x["kind"].alias("kind"), x["label"].alias("label"))).alias("hints"))

        return bound({"declared": declared, "at": F.coalesce(declared, hit.cast("int"))}, told)

    made = bound({"lines": lines, "found": found, "modules": modules, "solid": solid, "hits": F.array_sort(F.array_distinct(hits))}, whole)
    return rows.select("path", F.inline(made)).where("size(hints) > 0")


def swift_surroundings(rows: DataFrame) -> DataFrame:
    """(path, ext, line_no, line, context, marks): context, the line of the type that a Swift line stands in, and marks, the
    attributes between the last type or member above and the line, top down and each once."""
    opens = lambda x: F.trim(x).rlike("^(extension|struct|class|protocol|actor|enum) ")
    stops = lambda x: opens(x) | F.trim(x).rlike("^(func |init|let |var )")

    def whole(v: Column) -> Column:
        lines, stop, mark = v["lines"], v["stop"], v["mark"]
        n = F.size(lines)
        # Places of the last stop above each line, and of the last mark above it: its marks are those after the stop.
        shifted = lambda found: F.slice(F.concat(F.array(F.lit(0)), at_or_above(found, n)), 1, n)

        def each(p: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                last = _nth(stop, F.get(p["stop"], i))
                text = F.get(lines, last - 1)
                upto = F.get(p["mark"], i)
                first = F.get(p["since"], F.coalesce(last, F.lit(0))) + 1
                held = F.slice(mark, first.cast("int"), F.greatest(upto - first + 1, F.lit(0)).cast("int"))
                marks = F.array_distinct(F.transform(held, lambda m: collapse(F.get(lines, m - 1))))
                return F.struct(x.alias("line"), F.when(opens(text), collapse(text)).alias("context"), marks.alias("marks"))

            return F.transform(lines, one)

        # since: how many marks stand at or above line n, 0 at 0.
        return bound({"stop": shifted(stop), "mark": shifted(mark), "since": F.concat(F.array(F.lit(0)), at_or_above(mark, n))}, each)

    lines = F.col("lines")
    made = bound({"lines": lines, "stop": numbers(lines, stops), "mark": numbers(lines, _is_attribute("@"))}, whole)
    found = rows.select("path", "ext", F.posexplode(made).alias("_i", "_m"))
    return found.select("path", "ext", (F.col("_i") + 1).cast("long").alias("line_no"), "_m.*")


# Definition and usage rules by language, each a pattern in which {s} is the symbol as a whole identifier.
_RUST = (
    ("function", r"\bfn {s}"),
    ("impl_type", r"\bimpl(<[^>]*>)?( [\w:<>, ]+ for)? (\w+::)*{s}"),
    ("trait", r"\btrait {s}"),
    ("struct", r"\bstruct {s}"),
    ("enum", r"\benum {s}"),
    ("macro_call", r"{s}!"),
    ("impl_trait_path", r"\bimpl(<[^>]*>)? {s}::[\w:]+(<[^>]*>)? for "),
    ("impl_trait", r"\bimpl(<[^>]*>)? {s}(<[^>]*>)? for "),
)
_SWIFT = (
    ("function", r"\bfunc {s}"),
    ("protocol", r"\bprotocol {s}"),
    ("protocol_member", r"^\s+func {s}[^{]*$"),
    ("initializer", r"\binit[?!]?\([^)]*{s}"),
    ("class_function", r"\bclass func {s}"),
    ("struct_function", r"\b(mutating|static) func {s}"),
    ("extension_function", r"^\s+((public|internal|private|fileprivate|open) )?func {s}"),
    ("actor_function", r"\b(nonisolated|isolated) func {s}"),
    ("member", r"\.{s}"),
    ("call", r"{s}\("),
    ("awaited_call", r"\bawait ([\w.]+\.)?{s}\("),
    ("attribute", r"@{s}"),
    ("conformance", r"\bextension [\w.]+ ?: ?([\w.]+, ?)*{s}"),
    ("generic_argument", r"<([^<>]*[ ,:<])?{s}[^<>]*>"),
)
_TS = (
    ("identifier", r"{s}"),
    ("call", r"{s}\("),
    ("method_call", r"\.{s}\("),
    ("class", r"\bclass {s}"),
    ("interface", r"\binterface {s}"),
    ("interface_type", r"\binterface {s} ?[<{]"),
    ("type_alias", r"\btype {s}"),
    ("type_alias_type", r"\btype {s}(<[^>]*>)? ?="),
    ("method", r"^\s+((public|private|protected|static|async) )*{s}\([^)]*\)[^;]*\{"),
    ("variable", r"\b(const|let|var) {s}"),
    ("jsx_element", r"<{s}"),
    ("arrow_variable", r"\b(const|let|var) {s}.*=>"),
    ("export_value", r"\bexport (default |= ?){s}"),
    ("export_specifier", r"\bexport \{[^}]*{s}[^}]*\}"),
    ("jsx_attribute", r"<[^>]* {s}="),
    ("satisfies", r"{s} satisfies "),
)
RULES = tuple((lang, rule, pattern) for lang, rules in (("rust", _RUST), ("swift", _SWIFT), ("ts", _TS), ("tsx", _TS), ("other", (("identifier", r"{s}"),))) for rule, pattern in rules)
RULE_EXTENSIONS = {"rust": "rs", "swift": "swift", "ts": "ts", "tsx": "tsx"}


def rule_pattern(pattern: str, symbol: str) -> str:
    """A rule's pattern for a symbol, which may hold any characters: letters, digits, underscores and dollar signs don't touch it."""
    escaped = re.sub(r"([^A-Za-z0-9_])", r"\\\1", symbol)
    return pattern.replace("{s}", rf"(?<![\w$]){escaped}(?![\w$])")


def rule_matches(lines: DataFrame, symbol: str, languages: list[str], budget: int | None = None) -> DataFrame:
    """(language, rule, path, line_no): lines where a rule of their language matches. "other", and any language without rules
    of its own, stands for files that none of the other languages has. With a budget the first so many lines (path, line_no)
    by language, rule and place are taken, each once, and all their rules returned."""
    asked = {lang if lang in RULE_EXTENSIONS else "other" for lang in languages}
    held = lines.where(F.contains("line", F.lit(symbol)))
    tests = []
    for lang, rule, pattern in RULES:
        if lang in asked:
            own = F.col("ext") == RULE_EXTENSIONS[lang] if lang in RULE_EXTENSIONS else ~F.coalesce("ext", F.lit("")).isin(*RULE_EXTENSIONS.values())
            tests.append(F.when(own & F.rlike("line", F.lit(rule_pattern(pattern, symbol))), F.struct(F.lit(lang).alias("language"), F.lit(rule).alias("rule"))))
    if not tests:
        return held.where("false").select(F.lit("").alias("language"), F.lit("").alias("rule"), "path", "line_no")
    found = held.select("path", "line_no", F.explode(F.array_compact(F.array(*tests))).alias("m")).select("m.language", "m.rule", "path", "line_no")
    return found if budget is None else first_matches(found, budget)


def first_matches(found: DataFrame, budget: int) -> DataFrame:
    """The matches of the first so many lines by language, rule and place."""
    at = F.array_position(F.array(*(F.lit(f"{lang} {rule}") for lang, rule, _ in RULES)), F.concat_ws(" ", "language", "rule"))
    first = found.groupBy("path", "line_no").agg(F.min(at).alias("at")).orderBy("at", "path", "line_no").limit(budget)
    return found.join(F.broadcast(first.select("path", "line_no")), ["path", "line_no"], "left_semi")
