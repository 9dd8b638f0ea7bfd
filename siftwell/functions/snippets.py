"""Snippets: a matched text made short, with tags for what it does. A text may have several lines; one is picked."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.operators.structure import collapse


def _tag(test: Column, tag: str) -> Column:
    return F.when(test, F.lit(f" [{tag}]")).otherwise(F.lit(""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: x != "")


def default(text: Column) -> Column:
    """The first line that isn't blank; null if there is none."""
    return F.nullif(collapse(F.get(F.filter(F.split(text, "\n", -1), lambda x: collapse(x) != ""), F.lit(0))), F.lit(""))


def typescript(text: Column) -> Column:
    """The picked line with tags for async, hooks, components, promises, arrows, await, generics, satisfies.

    Picked is the first line with a tag or type brackets, else the last that exports, names a type or holds an arrow, else
    the first. A line that begins with a tag stays bare. Comments and blanks are passed over.
    """
    lines = _filled(_lines(text))
    told = F.filter(lines, lambda x: ~F.startswith(x, F.lit("//")))
    angled = F.filter(told, lambda x: F.startswith(x, F.lit("<")) | (F.contains(x, F.lit("<")) & F.contains(x, F.lit(">"))))
    named = F.filter(told, lambda x: x.rlike("^(export|type |interface )|=>"))
    picked = F.coalesce(F.get(angled, F.lit(0)), F.try_element_at(named, F.lit(-1)), F.get(lines, F.lit(0)))
    return _let(F.struct(picked.alias("line"), F.get(angled, F.lit(0)).isNotNull().alias("angled")), lambda p: _tagged_typescript(p["line"], p["angled"]))


def _tagged_typescript(line: Column, angled: Column) -> Column:
    def holds(*parts: str) -> Column:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(line, F.lit(p))
        return test

    tags = F.concat(
        _tag(holds("async"), "async"), _tag(F.startswith(line, F.lit("use")) | holds(" = use"), "hook"), _tag(holds("React.FC", "React.FunctionComponent"), "component"),
        _tag(holds("React.forwardRef", "React.memo"), "component"), _tag(holds("Promise<"), "promise"), _tag(holds("=>"), "arrow"), _tag(holds("await "), "await"),
        _tag(holds("<") & holds(">"), "generic"), _tag(holds("satisfies "), "satisfies"),
    )
    short = collapse(line)
    return F.when(angled & F.startswith(line, F.lit("<")), short).otherwise(F.concat(short, tags))


# What begins a Swift declaration, and a line that carries one on.
SWIFT_OPENS = "^(func |protocol |extension |struct |class |actor |enum |init[( ])"
SWIFT_GOES_ON = r"^(\)|async|throws|rethrows|->|where |some )"


def _let(value: Column, body) -> Column:
    """body(value) with value written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def swift(text: Column, context: Column, marks: Column) -> Column:
    """The declaration with the lines that carry it on, with tags, after its type's line and before its attributes.

    context: the enclosing type's line or null; marks: attributes above, an array or null. Attributes among the text's own
    lines come too, and so does a type right above the declaration there.
    """
    none = F.lit(None).cast("string")

    def marked(x: Column) -> Column:
        return F.startswith(x, F.lit("@"))

    def place(lines: Column) -> Column:
        filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != "")
        opening = F.filter(filled, lambda s: s["x"].rlike(SWIFT_OPENS))
        return F.coalesce(F.get(opening, F.lit(0))["i"], F.get(filled, F.lit(0))["i"])

    def carried_on(after: Column) -> Column:
        ends = F.filter(F.transform(after, lambda x, i: F.struct(i.alias("i"), (~(x.rlike(SWIFT_GOES_ON) | marked(x))).alias("end"))), lambda s: s["end"])
        return F.slice(after, F.lit(1), F.coalesce(F.get(ends, F.lit(0))["i"], F.size(after)))

    def tagged(whole: Column) -> Column:
        lowered = F.lower(whole)
        access = F.lit("")
        for word in ("open", "fileprivate", "private", "internal", "public"):
            access = F.when(lowered.rlike(f"^{word}| {word}[ (]"), F.lit(f" [{word}]")).otherwise(access)
        generic = F.contains(whole, F.lit("<")) & F.contains(whole, F.lit(">"))
        return F.concat(whole, _tag(F.contains(whole, F.lit("async")), "async"), _tag(F.contains(lowered, F.lit("await ")), "await"), access, _tag(generic, "generic"))

    def around(lines: Column, at: Column, more: Column) -> Column:
        whole = collapse(F.array_join(F.concat(F.array(F.get(lines, at)), F.filter(more, lambda x: ~marked(x))), " "))
        before = F.filter(F.slice(lines, F.lit(1), at), lambda x: x != "")
        nearest = F.try_element_at(F.filter(before, lambda x: ~marked(x)), F.lit(-1))
        inner = _let(nearest, lambda x: F.when(x.rlike("^(extension|struct|class|protocol|actor|enum) "), collapse(x)))
        own = F.transform(F.filter(F.concat(before, more), marked), collapse)
        every = F.array_distinct(F.concat(F.coalesce(marks, F.array().cast("array<string>")), own))
        tail = F.array_join(F.transform(every, lambda m: F.concat(F.lit(" ["), m, F.lit("]"))), "")
        head = F.coalesce(F.concat(F.coalesce(inner, context), F.lit(" :: ")), F.lit(""))
        return F.concat(head, _let(whole, tagged), tail)

    def picked(lines: Column) -> Column:
        def from_place(at: Column) -> Column:
            more = _let(F.slice(lines, at + 2, F.size(lines)), carried_on)
            return F.when(at.isNull(), none).otherwise(_let(more, lambda m: around(lines, at, m)))

        return _let(place(lines), from_place)

    return _let(_lines(text), picked)


def formatted(text: Column, ext: Column, context: Column, marks: Column, extensions: Collection[str] = ("swift", "ts", "tsx")) -> Column:
    """A snippet by the file's language; extensions: which languages can be there, so that no others are planned."""
    e, out = F.lower(ext), default(text)
    if {"ts", "tsx"} & set(extensions):
        out = F.when(e.isin("ts", "tsx"), typescript(text)).otherwise(out)
    if "swift" in extensions:
        out = F.when(e == "swift", swift(text, context, marks)).otherwise(out)
    return out
