"""Symbol rewriting and symbol tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed templates of query variants; {s}: the symbol, {h}: its type hint.
BASE = ("{s}", "{s} {h}", "{s} error", "{h}.{s}")
TS = ("{s}<", "{s} <", "<{s}", "</{s}", "{s} extends", "type {s}", "interface {s}", "const {s}", "export const {s}", "function {s}", "export function {s}", "{s}(", "{s} satisfies", "namespace {s}", "export default {s}", "{s} props", "{s}:")
TS_HOOK = ("{s}(", "{s}<{")
TS_UPPER = ("<{s} ", "<{s} />", "{s}Props", "{s}Component", "<{s} {...", "React.memo({s}", "React.forwardRef({s}")
RUST = ("fn {s}", "impl {s}", "trait {s}", "pub(crate) {s}", "{s}::<", "::{s}", "macro_rules! {s}")
SWIFT = ("func {s}", "func {s}(", "func {s}<", "{s} async", "@MainActor func {s}", "{s}(", ".{s}", "self.{s}", "await {s}")
SWIFT_UPPER = ("@{s}", ": {s}", "extension {s}", "where {s}")
# Language tokens and what they stand for; languages and their extensions.
TOKENS = {"ts": ("ts", "tsx"), "js": ("js", "jsx"), "kt": ("kt", "kts"), "rs": ("rust",), "swiftui": ("swift",)}
LANGUAGE_EXTENSIONS = {"rust": ("rs",), "swift": ("swift",), "ts": ("ts",), "tsx": ("tsx",), "js": ("js",), "jsx": ("jsx",), "python": ("py",), "py": ("py",), "kt": ("kt",), "kts": ("kts",)}


def escape_literal(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\.+*?^$()\[\]{}|])", r"\\$1")


def is_literal_symbol(s: Column) -> Column:
    return F.trim(s).rlike("^[A-Za-z0-9_]+$")


def ast_eligible(s: Column) -> Column:
    return F.trim(s).rlike("^[A-Za-z0-9_$]+$")


def capitalize(s: Column) -> Column:
    """Upper-cases an ASCII first letter."""
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.concat(F.translate(F.substring(s, 1, 1), low, low.upper()), F.substring(s, 2, 1 << 30))


def type_hint(s: Column) -> Column:
    """The last part of a name with an underscore, else its part from the last upper-case letter, else all; capitalised."""
    last = capitalize(F.element_at(F.split(s, "[:_.]"), -1))
    tail = F.regexp_extract(s, r"(\p{Lu}\P{Lu}*)$", 1)
    hint = F.when(F.contains(s, F.lit("_")), last).when(tail != "", tail).otherwise(capitalize(s))
    return F.when(hint == "", F.lit("value")).otherwise(hint)


def fill(template: str, s: Column, hint: Column) -> Column:
    parts = []
    for i, piece in enumerate(template.split("{s}")):
        if i:
            parts.append(s)
        for j, rest in enumerate(piece.split("{h}")):
            if j:
                parts.append(hint)
            if rest:
                parts.append(F.lit(rest))
    return F.concat(*parts)


def starts_upper(s: Column) -> Column:
    return s.rlike(r"^\p{Lu}")


def rewrites(s: Column, language: str | None = None) -> Column:
    """All query variants of a symbol, escaped, in order, each once."""
    hint = type_hint(s)

    def made(templates: tuple[str, ...]) -> Column:
        return F.array(*(fill(t, s, hint) for t in templates))

    def only(test: Column, templates: tuple[str, ...]) -> Column:
        return F.when(test, made(templates)).otherwise(F.array().cast("array<string>"))

    sets = [made(BASE)]
    if language in ("ts", "tsx"):
        sets += [made(TS), only(s.rlike("^use.+"), TS_HOOK), only(starts_upper(s), TS_UPPER)]
    elif language == "rust":
        sets.append(made(RUST))
    elif language == "swift":
        sets += [made(SWIFT), only(starts_upper(s), SWIFT_UPPER)]
    return F.array_distinct(F.transform(F.concat(*sets), escape_literal))


def rewritten(symbols: DataFrame, language: str | None = None) -> DataFrame:
    """(symbol, pos, query) for each symbol."""
    exploded = symbols.select("symbol", F.posexplode(rewrites(F.trim("symbol"), language)).alias("pos", "query"))
    return exploded.select("symbol", F.col("pos").cast("long").alias("pos"), "query")


def insensitive(symbol: str, language: str | None = None) -> bool:
    """Smart case: letters match in either case only if no variant of the symbol has an upper-case letter."""
    import re

    hint = python_hint(symbol)
    forms = [t.replace("{s}", symbol).replace("{h}", hint) for t in BASE + {"rust": RUST, "swift": SWIFT, "ts": TS, "tsx": TS}.get(language or "", ())]
    return not any(c.isupper() for f in forms for c in re.sub(r"\\.", "", f))


def variants(symbol: str, language: str | None = None) -> list[str]:
    """All query variants of one symbol on the driver, in the order of rewrites, without escapes."""
    import regex

    s, upper = symbol.strip(), bool(regex.match(r"\p{Lu}", symbol.strip()))
    sets = [BASE]
    if language in ("ts", "tsx"):
        sets += [TS, TS_HOOK if regex.match("use.", s) else (), TS_UPPER if upper else ()]
    elif language == "rust":
        sets.append(RUST)
    elif language == "swift":
        sets += [SWIFT, SWIFT_UPPER if upper else ()]
    hint = python_hint(s)
    return list(dict.fromkeys(t.replace("{s}", s).replace("{h}", hint) for x in sets for t in x))


def python_hint(symbol: str) -> str:
    """type_hint of one symbol, on the driver."""
    import re

    s = symbol.strip()
    if "_" in s:
        hint = re.split("[:_.]", s)[-1]
        hint = hint[:1].upper() + hint[1:] if hint[:1].isascii() else hint
    else:
        upper = [i for i, c in enumerate(s) if c.isupper()]
        hint = s[upper[-1] :] if upper else (s[:1].upper() + s[1:] if s[:1].isascii() else s)
    return hint or "value"


def expand_languages(token: Column) -> Column:
    """Languages that a hint stands for, each once: auto- hints split at - + | and comma, others at + | and comma."""
    text = F.lower(F.trim(token))
    auto = F.startswith(text, F.lit("auto-"))
    parts = F.when(auto, F.split(F.substring(text, 6, 1 << 30), "[-+|,]")).otherwise(F.split(text, "[+|,]"))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    known = F.create_map(*(x for t, to in TOKENS.items() for x in (F.lit(t), F.array(*map(F.lit, to)))))
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), F.array(x)))))


def extensions_of(languages: list[str]) -> list[str]:
    return list(dict.fromkeys(e for x in languages for e in LANGUAGE_EXTENSIONS.get(x, ())))
