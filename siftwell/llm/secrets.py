"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: alternatives of sets of trigrams one of which
every match must contain. Postings of those trigrams are intersected per alternative, and only candidate texts are scanned
with the rule. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import itertools
import re
from re import _constants as ops
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import apart, map_text, text_keys

# A private key runs from its header to the next END line, whatever marks of quotes or comments its lines carry. Without
# one it runs to the last base64 line: header fields, then lines of base64 alone, and long runs after any gap.
_BREAK = r"[\x20\t]*(?:\r?\n|\\r\\n|\\n)"
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:\x20[^\r\n\\]*)*+"
    rf"(?:{_BREAK}[\x20\t>#*|\"']*+[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t]*(?:[\r\n\"'`<,;\\]|\Z))"
    r"|(?:[\s>#*|\"'`,;+]|\\[nrt])++(?:[A-Za-z0-9+/]{20,}+={0,2}|[A-Za-z0-9+/]++={1,2})(?![\w.:=-]))*+)"
)
# Fixed patterns. Kind: pattern, group that holds the secret, least length of that group.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "private_key": (_KEY, 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "stripe": (r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "bearer": (r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}", 0, 1),
}
BASE = ("assign", "access", "hex")
MOST = 24
"""Most alternatives of a run of literals before it is closed."""
MOST_CLAUSES = 64
"""Most alternatives of a query."""


def _strings(node) -> set[str] | None:
    """All texts that a parsed node matches, if they are few; None if not."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN and len(arg) <= 8 and all(o is ops.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is ops.SUBPATTERN:
        return _sequence(arg[3])
    if op is ops.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is ops.MAX_REPEAT and arg[1] <= 2 and (inner := _sequence(arg[2])) is not None:
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(inner, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _runs(nodes) -> list[set[str]]:
    """Runs of literals that every match contains, each as a set of alternatives."""
    runs, now = [], {""}
    for node in nodes:
        op, arg = node
        more = _strings(node)
        if more is not None and len(now) * len(more) <= MOST:
            now = {a + b for a in now for b in more}
            continue
        runs.append(now)
        now = more if more is not None else {""}
        if op is ops.SUBPATTERN and more is None:
            runs += _runs(arg[3])
        elif op is ops.MAX_REPEAT and arg[0] > 0 and more is None:
            runs += _runs(arg[2])
    return [*runs, now]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of a pattern: alternatives of lower-case trigrams, one of which every match holds whole.

    Every run of literals must be in a match, so the runs are joined by AND: an alternative takes one choice of each run.
    Runs without trigrams demand nothing. Empty if the pattern demands nothing at all.
    """
    demands = []
    for run in _runs(parser.parse(pattern)):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(sets):
            demands.append(sets)
    query: set[frozenset[str]] = set()
    # The strictest runs first; a run that would make too many alternatives is left out, which only adds candidates.
    for sets in sorted(demands, key=lambda d: (-min(map(len, d)), len(d), sorted(map(sorted, d)))):
        joined = {a | b for a in query for b in sets} if query else sets
        if len(joined) <= MOST_CLAUSES:
            query = joined
    # An alternative that holds another one whole adds nothing.
    return sorted((q for q in query if not any(o < q for o in query)), key=sorted)


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


def postings(docs: DataFrame, codes: list[int]) -> DataFrame:
    """(k1, k2, trigram): which of the trigrams each distinct text holds; letters A-Z count as lower case."""

    def start():
        table = np.zeros(1 << 24, np.bool_)
        table[codes] = True

        def make(texts: list) -> list:
            out = []
            for t in texts:
                b = np.frombuffer((t or "").encode("utf-8", "replace").lower(), np.uint8).astype(np.int32)
                grams = b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b[:0]
                out.append(np.unique(grams[table[grams]]))
            return [out]

        return make

    k1, k2 = text_keys(F.col("text"))
    found = map_text(docs.select("text", k1.alias("k1"), k2.alias("k2")), ["k1", "k2"], {"found": "array<int>"}, start)
    return found.select("k1", "k2", F.explode("found").alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(k1, k2, kinds): the rules, as bits in their order, whose trigram query a text satisfies."""
    spark = docs.sparkSession
    rows, n = [], itertools.count()
    for bit, (pattern, _, _) in enumerate(rules.values()):
        for grams in trigram_query(pattern):
            clause = next(n)
            rows += [(clause, 1 << bit, len(grams), _code(g)) for g in sorted(grams)]
    asked = spark.createDataFrame(rows, "clause int, bit long, size int, trigram int")
    index = postings(docs, sorted({r[3] for r in rows}))
    held = index.join(F.broadcast(asked), "trigram").groupBy("k1", "k2", "clause", "bit", "size").agg(F.count("*").alias("held")).where("held = size")
    return held.groupBy("k1", "k2").agg(F.expr("bit_or(bit)").alias("kinds"))


def _packed(docs: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """docs with _packed: the rules to run on the row, as bits, and the text. A null text gives null."""
    whole = sum(1 << i for i, (p, _, _) in enumerate(rules.values()) if not trigram_query(p))
    found = candidates(docs, rules).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "kinds": "_kinds"})
    k1, k2 = text_keys(F.col("text"))
    keyed = docs.withColumns({"_t1": k1, "_t2": k2})
    joined = keyed.join(found, (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")), "left")
    kinds = F.coalesce("_kinds", F.lit(0)).bitwiseOR(F.lit(whole))
    return joined.select(*docs.columns, F.concat(kinds.cast("string"), F.lit("\0"), F.col("text")).alias("_packed"))


def _spans(packed: str, compiled: list[tuple]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text of a packed row and its spans (start, rule, end), sorted."""
    bits, _, text = packed.partition("\0")
    kinds, spans = int(bits), []
    for i, pattern, group, least in compiled:
        if kinds >> i & 1:
            spans += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return text, sorted(spans)


def _compiled(rules: dict[str, tuple[str, int, int]]) -> list[tuple]:
    return [(i, re.compile(p, re.ASCII), g, least) for i, (p, g, least) in enumerate(rules.values())]


def scan_secrets(docs: DataFrame, keep: list[str], rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """The kept columns with kinds_found (array<int>: rule numbers), starts and ends (array<int>: code points).

    Spans are sorted by start, then by rule. Null and empty texts have none. Every row is scanned whole; repeated rows
    each come back. Extra columns pass if kept; an empty table gives an empty one.
    """
    rules = rules or RULES

    def start():
        compiled = _compiled(rules)

        def one(packed: str | None) -> tuple[list, list, list]:
            spans = _spans(packed, compiled)[1] if packed is not None else []
            return [s[1] for s in spans], [s[0] for s in spans], [s[2] for s in spans]

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    return map_text(_packed(docs, rules), keep, {"kinds_found": "array<int>", "starts": "array<int>", "ends": "array<int>"}, start, text="_packed")


def redact(docs: DataFrame, mark: str = "[secret]", rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """docs with every secret span replaced by a mark; null texts stay null, the other columns stay, n_chars follows the text
    if there is one. Spans that overlap become one mark."""
    rules = rules or RULES
    docs, named = apart(docs, "text", "n_chars")
    cols = docs.columns

    def start():
        compiled = _compiled(rules)

        def one(packed: str | None) -> str | None:
            if packed is None:
                return None
            text, spans = _spans(packed, compiled)
            out, at = [], 0
            for s, _, e in spans:
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return lambda texts: [[one(x) for x in texts]]

    out = map_text(_packed(docs, rules), [c for c in cols if c != "text"], {"text": "string"}, start, text="_packed")
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return named(out)


def digests(spans: DataFrame, rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans."""
    names = F.array(*(F.lit(k) for k in rules or RULES))
    each = F.arrays_zip(F.col("kinds_found").alias("k"), F.col("starts").alias("s"), F.col("ends").alias("e"))

    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(i: int):
        return F.size(F.filter("kinds_found", lambda k: k == i)).cast("long")

    spans = spans.withColumn("_all", each)
    return spans.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(joined(F.filter("_all", lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    )
