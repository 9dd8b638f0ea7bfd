"""All queries of the library's own operators, and the SQL that they are compared with.

Each query runs an operator over whole tables; the documents table is seen as a tree of files, as sources.corpus says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import rewrite, snippets
from siftwell.operators import batch, index, observe, ranges, scopes, search, state, structure, topk, trigrams
from siftwell.sources import corpus
from siftwell.sources.corpus import BROKEN_SQL, CODE_SQL, FILES_SQL, LANGUAGES, LINES_SQL, shared_folder
from siftwell.streaming import state as streams, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SYMBOL = "the"

# Fixed rows: names, trees and settings that the driver's tables lack.
NAMES = ("login_user", "getUser", "UserCard", "foo", "foo_1", "HTTP", "a::b_c", "useThing", "$scope", "x.y", "a+b", "É", "fetchUser", "[a]{b}|(c)^d*")
LANGUAGE_HINTS = ("ts", "TSX", "js", "kt", "rs", "swiftui", "auto-swift-ts", "go", "rust+ts|py,js", "auto-js+kt", " ts ")
ORIGINS = (("rg-global", "rust"), ("rg-scoped", None), ("rga", "tsx"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def strings(spark: SparkSession, values: tuple, name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _values(rows: tuple, *names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") AS v({', '.join(names)})"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of the benchmark texts, and fixed names."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", " ")).alias("symbol")).where("symbol <> ''")
    return words.union(strings(spark, NAMES, "symbol")).distinct()


SYMBOLS_SQL = f"symbols AS (SELECT DISTINCT symbol FROM (SELECT unnest(string_split(text, ' ')) AS symbol FROM benchmark UNION ALL SELECT symbol FROM {_values(NAMES, 'symbol')}) WHERE symbol <> '')"
files = corpus.document_files


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines_of(files(spark, sf_dir))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.code_lines(files(spark, sf_dir))


def code_rows(spark: SparkSession, sf_dir: str, *extensions: str) -> DataFrame:
    """(path, ext, lines): files of code, the lines as an array."""
    return corpus.code_files(files(spark, sf_dir)).where(F.col("ext").isin(*extensions))


def hits(spark: SparkSession, sf_dir: str, symbol: str = SYMBOL, origin: str = "rg-global") -> DataFrame:
    return search.as_hits(search.probe(files(spark, sf_dir), symbol), origin)


HITS_SQL = LINES_SQL + f", hits AS (SELECT path, ext, line_no, line AS snippet, length(line) + 1 AS snippet_length, length(line) + 1 >= 200 AS truncated, 'rg-global' AS origin, 1.0::DOUBLE AS score FROM lines WHERE contains(line, '{SYMBOL}'))"
LANGUAGE_SQL = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in LANGUAGES.items()) + " END"
CANDIDATES_SQL = "cands AS (SELECT path FROM files WHERE regexp_matches(name, '^[0-9]*7') ORDER BY path LIMIT 200)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_name(files(spark, sf_dir), "^[0-9]*7")


# Sources and projections


@query("scan_lines", f"WITH {LINES_SQL} SELECT path, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY path")
def scan_lines(spark, d):
    return lines(spark, d).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("path_normalize", f"WITH {FILES_SQL} SELECT path, CASE WHEN starts_with(path, 'src0/') THEN substr(path, 6) ELSE path END AS relative FROM files")
def path_normalize(spark, d):
    return files(spark, d).select("path", corpus.normalize_path(F.col("path"), "src0").alias("relative"))


@query("detect_language", f"WITH {FILES_SQL} SELECT path, {LANGUAGE_SQL} AS language FROM files")
def detect_language(spark, d):
    return files(spark, d).select("path", search.language_of(F.col("ext")).alias("language"))


@query("origin_label", f"WITH {FILES_SQL} SELECT path, origin, CASE WHEN {LANGUAGE_SQL} IS NULL THEN origin ELSE origin || ' [' || {LANGUAGE_SQL} || ']' END AS label FROM files, (SELECT unnest(['rg-global', 'rga']) AS origin)")
def origin_label(spark, d):
    held = files(spark, d).select("path", "ext", F.explode(F.array(F.lit("rg-global"), F.lit("rga"))).alias("origin"))
    return held.select("path", "origin", search.origin_label(F.col("origin"), search.language_of(F.col("ext"))).alias("label"))


@query("filter_extension", f"WITH {FILES_SQL} SELECT path, n_bytes FROM files WHERE ext IN ('ts', 'tsx', 'rs')")
def filter_extension(spark, d):
    return files(spark, d).where(F.lower("ext").isin(rewrite.extensions_of(["ts", "tsx", "rust"]))).select("path", "n_bytes")


# Rewriting


def _of_symbols(f):
    return lambda spark, d: symbols(spark, d).select("symbol", f(F.col("symbol")).alias("value"))


ESCAPE_SQL = r"regexp_replace({s}, '([\\.+*?^$()\[\]{{}}|])', '\\\1', 'g')"
HINT_SQL = """CASE WHEN h0 = '' THEN 'value' ELSE h0 END"""
HINTS_SQL = (
    SYMBOLS_SQL
    + """, parts AS (SELECT symbol, string_split_regex(symbol, '[:_.]')[-1] AS p, regexp_extract(symbol, '(\\p{Lu}\\P{Lu}*)$', 1) AS u FROM symbols),
capital AS (SELECT symbol, p, u, CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || substr(p, 2) ELSE p END AS cp, CASE WHEN regexp_matches(symbol, '^[a-z]') THEN upper(symbol[1]) || substr(symbol, 2) ELSE symbol END AS cs FROM parts),
hinted AS (SELECT symbol, coalesce(nullif(CASE WHEN contains(symbol, '_') THEN cp WHEN u <> '' THEN u ELSE cs END, ''), 'value') AS hint FROM capital)"""
)
query("escape_literal", f"WITH {SYMBOLS_SQL} SELECT symbol, {ESCAPE_SQL.format(s='symbol')} AS value FROM symbols")(_of_symbols(rewrite.escape_literal))
query("is_literal_symbol", f"WITH {SYMBOLS_SQL} SELECT symbol, regexp_matches(symbol, '^[A-Za-z0-9_]+$') AS value FROM symbols")(_of_symbols(rewrite.is_literal_symbol))
query("ast_eligible", f"WITH {SYMBOLS_SQL} SELECT symbol, regexp_matches(symbol, '^[A-Za-z0-9_$]+$') AS value FROM symbols")(_of_symbols(rewrite.ast_eligible))
query("derive_type_hint", f"WITH {HINTS_SQL} SELECT symbol, hint AS value FROM hinted")(_of_symbols(rewrite.type_hint))


def _rewrite_sql(*sets: tuple[str, tuple[str, ...]]) -> str:
    """Rows of all templates in order; equal ones keep the first place, places are numbered anew."""
    rows, n = [], 0
    for test, templates in (("TRUE", rewrite.BASE), *sets):
        for t in templates:
            text = _quoted(t).replace("{s}", "' || symbol || '").replace("{h}", "' || hint || '")
            rows.append(f"SELECT symbol, {n} AS i, {text} AS q FROM hinted WHERE {test}")
            n += 1
    return f"""WITH {HINTS_SQL}, raw AS ({' UNION ALL '.join(rows)}), escaped AS (SELECT symbol, i, {ESCAPE_SQL.format(s='q')} AS query FROM raw),
first AS (SELECT symbol, query, min(i) AS i FROM escaped GROUP BY symbol, query)
SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY i) - 1)::BIGINT AS pos, query FROM first"""


UPPER_SQL = "regexp_matches(symbol, '^\\p{Lu}')"
query("rewrite_base", _rewrite_sql())(lambda spark, d: rewrite.rewritten(symbols(spark, d)))
query("rewrite_ts", _rewrite_sql(("TRUE", rewrite.TS), ("regexp_matches(symbol, '^use.+')", rewrite.TS_HOOK), (UPPER_SQL, rewrite.TS_UPPER)))(lambda spark, d: rewrite.rewritten(symbols(spark, d), "ts"))
query("rewrite_rust", _rewrite_sql(("TRUE", rewrite.RUST)))(lambda spark, d: rewrite.rewritten(symbols(spark, d), "rust"))
query("rewrite_swift", _rewrite_sql(("TRUE", rewrite.SWIFT), (UPPER_SQL, rewrite.SWIFT_UPPER)))(lambda spark, d: rewrite.rewritten(symbols(spark, d), "swift"))


@query(
    "expand_language",
    f"""WITH hints AS (SELECT token, lower(trim(token)) AS t FROM (SELECT token FROM {_values(LANGUAGE_HINTS, 'token')} UNION SELECT lang || '+' || source FROM documents)),
parts AS (SELECT token, CASE WHEN starts_with(t, 'auto-') THEN string_split_regex(substr(t, 6), '[-+|,]') ELSE string_split_regex(t, '[+|,]') END AS a FROM hints),
each AS (SELECT token, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM parts),
known(k, to_, j) AS (VALUES {', '.join(f"('{k}', '{x}', {j})" for k, to in rewrite.TOKENS.items() for j, x in enumerate(to))}),
wide AS (SELECT token, coalesce(to_, trim(x)) AS language, i, coalesce(j, 0) AS j FROM each LEFT JOIN known ON k = trim(x) WHERE trim(x) <> ''),
first AS (SELECT token, language, min(i * 10 + j) AS o FROM wide GROUP BY ALL)
SELECT token, (row_number() OVER (PARTITION BY token ORDER BY o) - 1)::BIGINT AS pos, language FROM first""",
)
def expand_language(spark, d):
    spoken = spark.read.parquet(f"{d}/documents.parquet").select(F.concat("lang", F.lit("+"), "source").alias("token")).where("token IS NOT NULL").distinct()
    out = strings(spark, LANGUAGE_HINTS, "token").union(spoken).select("token", F.posexplode(rewrite.expand_languages(F.col("token"))).alias("pos", "language"))
    return out.withColumn("pos", F.col("pos").cast("long"))


# Probes and candidates

query("probe_global", f"WITH {HITS_SQL} SELECT path, line_no, snippet FROM hits")(lambda spark, d: hits(spark, d).select("path", "line_no", "snippet"))
query("hits_project", f"WITH {HITS_SQL} SELECT path, line_no, snippet_length, truncated, origin, score FROM hits")(lambda spark, d: hits(spark, d).select("path", "line_no", "snippet_length", "truncated", "origin", "score"))


@query("probe_smart_case", f"WITH {LINES_SQL} SELECT 'Elle' AS symbol, path, line_no FROM lines WHERE contains(line, 'Elle') UNION ALL SELECT 'un_1', path, line_no FROM lines WHERE contains(lower(line), 'un_1') UNION ALL SELECT '_2', path, line_no FROM lines WHERE contains(lower(line), '_2')")
def probe_smart_case(spark, d):
    out = None
    for symbol in ("Elle", "un_1", "_2"):
        part = search.probe(files(spark, d), symbol, rewrite.insensitive(symbol)).select(F.lit(symbol).alias("symbol"), "path", "line_no")
        out = part if out is None else out.union(part)
    return out


def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "trigrams")
    trigrams.write(files(spark, d), folder)
    return trigrams.read(spark, folder)


@query("probe_pruned", f"WITH {LINES_SQL} SELECT 'eriner' AS symbol, path, line_no FROM lines WHERE contains(line, 'eriner') UNION ALL SELECT '_12', path, line_no FROM lines WHERE contains(lower(line), '_12') UNION ALL SELECT 'un', path, line_no FROM lines WHERE contains(line, 'un')")
def probe_pruned(spark, d):
    """Probes of files that hold all trigrams of a symbol; one of two letters has none and reads all."""
    f, held = files(spark, d), trigram_index(spark, d)
    out = None
    for symbol in ("eriner", "_12", "un"):
        fold = symbol == "_12"
        part = trigrams.pruned_probe(f, held, symbol, fold).select(F.lit(symbol).alias("symbol"), "path", "line_no")
        out = part if out is None else out.union(part)
    return out


PATTERNS = ("th(ane|inti)[a-z]+b", "er+iner", "(erineR|An)[a-z]{4}", "[a-z]*")


@query("regex_pruned", "WITH " + LINES_SQL + " " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, path, line_no FROM lines WHERE regexp_matches(line, '{p}')" for p in PATTERNS))
def regex_pruned(spark, d):
    """Lines that match a pattern, in files that hold the trigrams which every match contains."""
    f, held = files(spark, d), trigram_index(spark, d)
    out = None
    for p in PATTERNS:
        part = trigrams.pruned_matches(f, held, p).select(F.lit(p).alias("pattern"), "path", "line_no")
        out = part if out is None else out.union(part)
    return out


@query("probe_per_file_cap", f"WITH {HITS_SQL} SELECT path, line_no FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 3")
def probe_per_file_cap(spark, d):
    return search.capped_probe(files(spark, d), SYMBOL, 3).select("path", "line_no")


query("probe_capped", f"WITH {HITS_SQL} SELECT path, line_no FROM hits ORDER BY path, line_no LIMIT 20")(lambda spark, d: hits(spark, d).select("path", "line_no").orderBy("path", "line_no").limit(20))
query("discover_filename", f"WITH {FILES_SQL}, {CANDIDATES_SQL} SELECT path FROM cands")(candidates)
SCOPED_SQL = "scoped AS (SELECT path FROM cands ORDER BY path LIMIT 20)"
query("probe_scoped", f"WITH {HITS_SQL}, {CANDIDATES_SQL}, {SCOPED_SQL} SELECT path, line_no FROM hits WHERE path IN (SELECT path FROM scoped)")(
    lambda spark, d: search.probe(search.scoped(files(spark, d), candidates(spark, d), 20), SYMBOL).select("path", "line_no")
)


def dir_scores(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path", "dir")
    return hits(spark, d).select("path").join(f, "path").groupBy("dir").agg(F.count("*").alias("score"))


DIRS_SQL = HITS_SQL + ", dirs AS (SELECT dir, count(*)::BIGINT AS score FROM hits JOIN files USING (path) GROUP BY dir), top3 AS (SELECT * FROM dirs ORDER BY score DESC, dir LIMIT 3)"
ENTRIES_SQL = DIRS_SQL + ", entries AS (SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY name) AS pos, path, name FROM files WHERE dir IN (SELECT dir FROM top3)), shown AS (SELECT dir, pos::BIGINT AS pos, path FROM entries WHERE pos <= 5 AND NOT starts_with(name, '.'))"
query("top_directories", f"WITH {DIRS_SQL} SELECT dir, score FROM top3")(lambda spark, d: search.top_directories(dir_scores(spark, d)))


@query("discover_dir_hints", f"WITH {ENTRIES_SQL} SELECT dir, pos, path FROM shown")
def discover_dir_hints(spark, d):
    return search.directory_entries(files(spark, d), search.top_directories(dir_scores(spark, d)))


# The documents as a Swift package: swift files lie below Sources, every third of them directly.
PACKAGE_SQL = """package AS (SELECT 'Package.swift' AS path UNION ALL SELECT 'Sources/' || CASE WHEN doc_id % 30 = 1 THEN '' ELSE dir || '/' END || name FROM files WHERE ext = 'swift'),
cut AS (SELECT path, string_split(path, '/') AS a FROM package),
inside AS (SELECT path, len(a) AS n, a[2] AS child FROM cut WHERE lower(a[1]) = 'sources' AND len(a) <= 3),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY child) AS c, row_number() OVER (PARTITION BY child ORDER BY path) AS g FROM inside),
layout AS (SELECT 'Package.swift' AS path, 0::BIGINT AS level UNION ALL SELECT path, (n - 1)::BIGINT FROM numbered WHERE c <= 20 AND g <= 10)"""


def package(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("doc_id") % 30 == 1, F.lit("")).otherwise(F.concat("dir", F.lit("/")))
    held = files(spark, d).where("ext = 'swift'").select(F.concat(F.lit("Sources/"), folder, "name").alias("path"))
    return strings(spark, ("Package.swift",), "path").union(held)


query("discover_swift_layout", f"WITH {FILES_SQL}, {PACKAGE_SQL} SELECT path, level FROM layout")(lambda spark, d: search.swift_layout(package(spark, d)))


@query(
    "discover_union",
    f"""WITH {ENTRIES_SQL}, {CANDIDATES_SQL}, {PACKAGE_SQL.replace("cut AS", "pieced AS").replace("FROM cut", "FROM pieced")}, named AS (SELECT path, row_number() OVER (ORDER BY path) AS pos FROM cands),
whole AS (SELECT path, 0 AS src_rank, pos FROM named UNION ALL SELECT path, 1, doc_id FROM files WHERE doc_id % 50 = 0 UNION ALL SELECT path, 2, pos FROM shown UNION ALL SELECT path, 3, row_number() OVER (ORDER BY level, path) FROM layout)
SELECT path, src_rank::BIGINT AS src_rank, pos::BIGINT AS pos FROM whole QUALIFY row_number() OVER (PARTITION BY path ORDER BY src_rank, pos) = 1""",
)
def discover_union(spark, d):
    """All four sources in order: names, stored hints, popular directories, the package's layout."""
    f = files(spark, d)
    stored = f.select(F.lit(SYMBOL).alias("symbol"), "path", F.col("doc_id").alias("pos")).where("pos % 50 = 0")
    named = candidates(spark, d).withColumn("pos", F.row_number().over(Window.orderBy("path")))
    layout = search.swift_layout(package(spark, d)).withColumn("pos", F.row_number().over(Window.orderBy("level", "path")))
    return search.ordered_union(named, state.live_hints(stored, f, SYMBOL), discover_dir_hints(spark, d), layout)


# Scores, ranks, metrics

ADJUST_SQL = "score - 0.05"
STRUCT_SQL = "struct AS (SELECT DISTINCT path, line_no FROM lines WHERE ext NOT IN ('rs', 'swift', 'ts', 'tsx') AND regexp_matches(line, '(^|[^\\w$])the([^\\w$]|$)'))"


def matches(spark: SparkSession, d: str) -> DataFrame:
    return structure.rule_matches(lines(spark, d), SYMBOL, ["other"])


query("score_hits", f"WITH {HITS_SQL} SELECT path, line_no, {ADJUST_SQL} AS score FROM hits")(lambda spark, d: search.score(hits(spark, d)).select("path", "line_no", "score"))
SCORED_SQL = f"{HITS_SQL}, {CANDIDATES_SQL}, {STRUCT_SQL}, scored AS (SELECT h.path, h.ext, h.line_no, h.snippet, h.truncated, ({ADJUST_SQL} + CASE WHEN c.path IS NOT NULL THEN 0.2 ELSE 0.0 END) + CASE WHEN s.path IS NOT NULL THEN 0.5 ELSE 0.0 END AS score, CASE WHEN s.path IS NOT NULL THEN 'ast-grep' ELSE origin END AS origin FROM hits h LEFT JOIN cands c ON h.path = c.path LEFT JOIN struct s ON h.path = s.path AND h.line_no = s.line_no)"
query("score_fd_bonus", f"WITH {HITS_SQL}, {CANDIDATES_SQL} SELECT path, line_no, round({ADJUST_SQL} + CASE WHEN path IN (SELECT path FROM cands) THEN 0.2 ELSE 0.0 END, 6) AS score FROM hits")(
    lambda spark, d: search.score(hits(spark, d), candidates(spark, d)).select("path", "line_no", F.round("score", 6).alias("score"))
)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return search.score(hits(spark, d), candidates(spark, d), matches(spark, d)).withColumn("score", F.round("score", 6))


query("score_ast_boost", f"WITH {SCORED_SQL} SELECT path, line_no, round(score, 6) AS score, origin FROM scored")(lambda spark, d: scored(spark, d).select("path", "line_no", "score", "origin"))
SECOND_SQL = "merged AS (SELECT path, line_no, 0.95::DOUBLE AS score, 'rg-global' AS origin, 0 AS stage FROM hits UNION ALL SELECT path, line_no, CASE WHEN line_no % 2 = 0 THEN 1.1 ELSE 0.95 END, 'rg-indexed', 1 FROM hits WHERE line_no % 3 <> 0)"


def two_stages(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).select("path", "line_no")
    first = h.select("path", "line_no", F.lit(0.95).alias("score"), F.lit("rg-global").alias("origin"), F.lit(0).alias("stage"))
    again = h.where("line_no % 3 <> 0").select("path", "line_no", F.when(F.col("line_no") % 2 == 0, 1.1).otherwise(0.95).alias("score"), F.lit("rg-indexed").alias("origin"), F.lit(1).alias("stage"))
    return first.union(again)


query("dedup_argmax", f"WITH {HITS_SQL}, {SECOND_SQL} SELECT path, line_no, score::DOUBLE AS score, origin FROM merged QUALIFY row_number() OVER (PARTITION BY path, line_no ORDER BY score DESC, stage) = 1")(
    lambda spark, d: search.best_per_line(two_stages(spark, d)).select("path", "line_no", "score", "origin")
)
query("dedup_seen_anti", f"WITH {HITS_SQL} SELECT path, line_no FROM hits WHERE line_no % 3 = 0")(
    lambda spark, d: search.unseen(hits(spark, d), hits(spark, d).where("line_no % 3 <> 0")).select("path", "line_no")
)
RANK_SQL = "row_number() OVER (ORDER BY round(score, 6) DESC, path, line_no)"
query("rank_hits", f"WITH {SCORED_SQL} SELECT {RANK_SQL}::BIGINT AS rank, path, line_no, round(score, 6) AS score FROM scored ORDER BY 1 LIMIT 20")(
    lambda spark, d: search.top_hits(scored(spark, d), 20).select("rank", "path", "line_no", "score")
)
TOP_SQL = f"{SCORED_SQL}, top AS (SELECT {RANK_SQL}::BIGINT AS rank, * FROM scored ORDER BY 1 LIMIT 5)"


def top(spark: SparkSession, d: str) -> DataFrame:
    return search.top_hits(scored(spark, d))


query("top_hits", f"WITH {TOP_SQL} SELECT rank, path, line_no, round(score, 6) AS score, origin, snippet FROM top")(lambda spark, d: top(spark, d).select("rank", "path", "line_no", "score", "origin", "snippet"))
query("next_actions", f"WITH {TOP_SQL} SELECT rank, 'inspect ' || path || ':' || line_no AS action FROM top")(lambda spark, d: search.next_actions(top(spark, d)))
query("distinct_files", f"WITH {HITS_SQL} SELECT DISTINCT path FROM hits")(lambda spark, d: hits(spark, d).select("path").distinct())


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


METRICS_SQL = f"""totals AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT path) AS f, max(line_no) - min(line_no) AS span, (SELECT count(*) FROM struct) AS s, (SELECT count(*) FROM cands) AS c FROM hits),
parts AS (SELECT s / n AS p, (n / f) / (n / f + 1) AS d, 1 / (1 + span / (n + 1)) AS k, CASE WHEN c = 0 THEN 0 ELSE least(n, c) / c END AS b FROM totals)
SELECT {r2('p')} AS precision, {r2('d')} AS density, {r2('k')} AS clustering, {r2('0.5::DOUBLE * p + 0.3::DOUBLE * d + 0.15::DOUBLE * k + 0.05::DOUBLE * b')} AS reward FROM parts"""


@query("metrics_reward", f"WITH {HITS_SQL}, {CANDIDATES_SQL}, {STRUCT_SQL}, {METRICS_SQL}")
def metrics_reward(spark, d):
    s = matches(spark, d).select("path", "line_no").distinct().agg(F.count("*").alias("_s"))
    c = candidates(spark, d).agg(F.count("*").alias("_c"))
    held = hits(spark, d).select("path", "line_no").withColumn("_one", F.lit(1))
    held = held.join(F.broadcast(s.withColumn("_one", F.lit(1))), "_one").join(F.broadcast(c.withColumn("_one", F.lit(1))), "_one")
    return search.metrics(held, F.col("_s"), F.col("_c"))


query("language_counts", f"WITH {HITS_SQL} SELECT coalesce({LANGUAGE_SQL}, 'other') AS language, count(*)::BIGINT AS n FROM hits GROUP BY 1")(lambda spark, d: search.language_counts(hits(spark, d)))


@query("language_metrics", f"WITH {HITS_SQL}, staged AS (SELECT ext, 'discover' AS stage FROM files UNION ALL SELECT ext, 'probe' FROM hits) SELECT coalesce({LANGUAGE_SQL}, 'other') AS language, count(*) FILTER (stage = 'discover')::BIGINT AS n_discover, count(*) FILTER (stage = 'probe')::BIGINT AS n_probe FROM staged GROUP BY 1")
def language_metrics(spark, d):
    staged = files(spark, d).select("ext", F.lit("discover").alias("stage")).union(hits(spark, d).select("ext", F.lit("probe").alias("stage")))
    return search.language_metrics(staged, ["discover", "probe"])


@query("distribute_latency", f"WITH {HITS_SQL}, k AS (SELECT DISTINCT coalesce({LANGUAGE_SQL}, 'other') AS language FROM hits), n AS (SELECT count(*) AS n FROM k) SELECT language, (1003 // n + CASE WHEN row_number() OVER (ORDER BY language) <= 1003 % n THEN 1 ELSE 0 END)::BIGINT AS share_ms FROM k, n")
def distribute_latency(spark, d):
    return search.distribute(F.lit(1003), search.language_counts(hits(spark, d)).select("language"), "language")


# Context

WINDOW_SQL = """held AS (SELECT t.*, f.body, f.n_bytes, p.a, greatest(1, t.line_no - {b}) AS s, least(len(p.a), t.line_no + {b})::BIGINT AS e FROM top t JOIN files f USING (path) JOIN cut p ON p.path = t.path)"""
PAD_SQL = "CASE WHEN truncated THEN 4 ELSE 2 END"
HELD_SQL = f"{TOP_SQL}, {WINDOW_SQL.format(b='(' + PAD_SQL + ')')}"


def context(spark: SparkSession, d: str, **kw) -> DataFrame:
    return search.with_context(top(spark, d), files(spark, d), **kw)


query("context_padding", f"WITH {HELD_SQL} SELECT rank, s::BIGINT AS context_start, e AS context_end, TRUE AS auto FROM held")(lambda spark, d: context(spark, d).select("rank", "context_start", "context_end", "auto"))
query(
    "context_window",
    f"WITH {TOP_SQL} SELECT rank, l.line_no, l.line FROM top t JOIN lines l ON l.path = t.path AND l.line_no BETWEEN t.line_no - 1 AND t.line_no + 1",
)(lambda spark, d: F.broadcast(top(spark, d).select("rank", F.col("path").alias("p"), F.col("line_no").alias("at"))).join(lines(spark, d), (F.col("p") == F.col("path")) & F.col("line_no").between(F.col("at") - 1, F.col("at") + 1)).select("rank", "line_no", "line"))
query(
    "expanded_snippet",
    f"WITH {HELD_SQL}, x AS (SELECT rank, e, unnest(range(s, e + 1)) AS i, a FROM held) SELECT rank, string_agg(lpad(i::VARCHAR, length(e::VARCHAR)::INT, '0') || ' ' || regexp_replace(a[i], '\\r$', ''), chr(10) ORDER BY i) || chr(10) AS text FROM x GROUP BY rank",
)(lambda spark, d: context(spark, d).select("rank", F.col("expanded_snippet").alias("text")))
query("fetch_body", f"WITH {HELD_SQL} SELECT rank, CASE WHEN n_bytes <= 8000 THEN length(body) END AS body_chars, n_bytes <= 8000 AS body_retrieved FROM held")(
    lambda spark, d: context(spark, d, max_body=8000, want_body=True).select("rank", F.length("body").cast("long").alias("body_chars"), "body_retrieved")
)

# Structure

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


LOW_SQL = f"lower({collapsed('line')})"
RUST_DECL_SQL = f"(NOT regexp_matches({LOW_SQL}, '^(//|/\\*|\\*/|#\\[|\\}}|$)') AND regexp_matches({LOW_SQL}, '(^|\\s)({'|'.join(rewrite_kw for rewrite_kw in structure.RUST_DECLARES)})[ (]'))"
SWIFT_SIGN_SQL = f"(NOT regexp_matches({LOW_SQL}, '^(//|/\\*|\\*/|@|\\}}|$)') AND regexp_matches({LOW_SQL}, '(^|\\s)({'|'.join(structure.SWIFT_SIGNS)})[ ({{<?]'))"
SWIFT_KIND_SQL = f"CASE WHEN regexp_matches({LOW_SQL}, '(^|\\s)(extension) ') THEN 'extension' WHEN regexp_matches({LOW_SQL}, '(^|\\s)({'|'.join(structure.SWIFT_TYPES)}) ') THEN 'type' END"
IMPL_SQL = f"regexp_matches({LOW_SQL}, '^(.{{0,31}}[^a-z0-9_]|)impl[ <(]')"
MODULE_SQL = f"(regexp_matches({LOW_SQL}, '^(.{{0,31}}[^a-z0-9_]|)mod ') AND length(line) = length(regexp_replace(line, '^\\s+', '')))"


def _above_sql(ext: str, test: str, frame: str = "ROWS UNBOUNDED PRECEDING") -> str:
    return f"""WITH {CODE_SQL}, found AS (SELECT path, line_no, last_value(CASE WHEN {test} THEN line_no END IGNORE NULLS) OVER w AS found_line, last_value(CASE WHEN {test} THEN {collapsed('line')} END IGNORE NULLS) OVER w AS found_text
FROM code WHERE ext = '{ext}' WINDOW w AS (PARTITION BY path ORDER BY line_no {frame})) SELECT path, line_no, found_line, found_text FROM found"""


def _above(ext: str, test, strict: bool = False):
    def run(spark, d):
        return structure.nearest_above(code_rows(spark, d, ext), test, "found", strict)

    return run


query("rust_declaration", _above_sql("rs", RUST_DECL_SQL))(_above("rs", structure.is_rust_declaration))
query("rust_impl", _above_sql("rs", IMPL_SQL, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))(_above("rs", structure.is_rust_impl, True))
query("swift_signature", _above_sql("swift", SWIFT_SIGN_SQL))(_above("swift", structure.is_swift_signature))
query("swift_type", _above_sql("swift", f"({SWIFT_KIND_SQL}) IS NOT NULL"))(_above("swift", lambda x: structure.swift_type_kind(x).isNotNull()))


def _attributes_sql(ext: str, mark: str) -> str:
    return f"""WITH {CODE_SQL}, flagged AS (SELECT path, line_no, line, starts_with(trim(line), '{mark}') AS a, NOT (starts_with(trim(line), '{mark}') OR trim(line) = '' OR starts_with(trim(line), '//')) AS solid FROM code WHERE ext = '{ext}'),
barrier AS (SELECT *, coalesce(last_value(CASE WHEN solid THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM flagged)
SELECT s.path, s.line_no, m.line_no AS attribute_line, {collapsed('m.line')} AS attribute FROM barrier s JOIN barrier m ON s.path = m.path AND m.line_no > s.b AND m.line_no < s.line_no WHERE s.solid AND m.a"""


query("rust_attributes", _attributes_sql("rs", "#["))(lambda spark, d: structure.attributes(code_rows(spark, d, "rs"), "#["))
query("swift_attributes", _attributes_sql("swift", "@"))(lambda spark, d: structure.attributes(code_rows(spark, d, "swift"), "@"))


@query(
    "rust_modules",
    f"""WITH {CODE_SQL}, rs AS (SELECT path, line_no, line, {MODULE_SQL} AS m, {RUST_DECL_SQL} AS decl FROM code WHERE ext = 'rs'),
mods AS (SELECT path, line_no, line FROM rs WHERE m)
SELECT r.path, r.line_no, m.line_no AS module_line, {collapsed('m.line')} AS module FROM rs r JOIN mods m ON r.path = m.path AND m.line_no <= r.line_no WHERE r.decl
QUALIFY row_number() OVER (PARTITION BY r.path, r.line_no ORDER BY m.line_no DESC) <= 3""",
)
def rust_modules(spark, d):
    return structure.last_modules(code_rows(spark, d, "rs"), structure.is_rust_declaration)


def _near_attributes(mark: str) -> str:
    return f"""SELECT a.path, a.line_no, m.line_no AS line, 'attribute' AS kind, {collapsed('m.line')} AS label FROM anchored a JOIN t m ON a.path = m.path AND m.line_no < a.at AND starts_with(trim(m.line), '{mark}')
WHERE a.ext = '{'rs' if mark == '#[' else 'swift'}' AND NOT EXISTS (SELECT 1 FROM t s WHERE s.path = a.path AND s.line_no > m.line_no AND s.line_no < a.at AND NOT (starts_with(trim(s.line), '{mark}') OR trim(s.line) = '' OR starts_with(trim(s.line), '//')))"""


@query(
    "context_hints",
    f"""WITH {CODE_SQL}, t AS (SELECT path, ext, line_no, line, CASE ext WHEN 'rs' THEN {RUST_DECL_SQL} ELSE {SWIFT_SIGN_SQL} END AS declares, ext = 'rs' AND {IMPL_SQL} AS impl, ext = 'rs' AND {MODULE_SQL} AS module, CASE WHEN ext = 'swift' THEN {SWIFT_KIND_SQL} END AS kind FROM code WHERE ext IN ('rs', 'swift')),
anchored AS (SELECT h.path, h.ext, h.line_no, max(d.line_no) AS declared, coalesce(max(d.line_no), h.line_no) AS at FROM t h LEFT JOIN t d ON d.path = h.path AND d.line_no <= h.line_no AND d.declares WHERE contains(h.line, '{SYMBOL}') GROUP BY h.path, h.ext, h.line_no),
found AS (SELECT path, line_no, declared AS line, 'declaration' AS kind, NULL AS label FROM anchored WHERE declared IS NOT NULL
  UNION ALL SELECT a.path, a.line_no, max(i.line_no), 'impl', NULL FROM anchored a JOIN t i ON i.path = a.path AND i.line_no < a.at AND i.impl GROUP BY a.path, a.line_no
  UNION ALL SELECT path, line_no, line, 'module', NULL FROM (SELECT a.path, a.line_no, m.line_no AS line FROM anchored a JOIN t m ON m.path = a.path AND m.line_no <= a.at AND m.module QUALIFY row_number() OVER (PARTITION BY a.path, a.line_no ORDER BY m.line_no DESC) <= 3)
  UNION ALL SELECT path, line_no, line, k, NULL FROM (SELECT a.path, a.line_no, max(i.line_no) AS line, arg_max(i.kind, i.line_no) AS k FROM anchored a JOIN t i ON i.path = a.path AND i.line_no <= a.at AND i.kind IS NOT NULL GROUP BY a.path, a.line_no)
  UNION ALL {_near_attributes('#[')} UNION ALL {_near_attributes('@')}),
told AS (SELECT DISTINCT f.path, f.line_no, f.line, f.kind, {collapsed('c.line')} AS label FROM found f JOIN t c ON c.path = f.path AND c.line_no = f.line),
ranked AS (SELECT *, CASE kind WHEN 'attribute' THEN 0 WHEN 'declaration' THEN 2 WHEN 'impl' THEN 3 WHEN 'module' THEN 4 ELSE 1 END AS o FROM told WHERE label <> '')
SELECT path, line_no, string_agg(line || ':' || kind || ':' || label, '|' ORDER BY line, o, kind, label) AS hints FROM ranked GROUP BY path, line_no""",
)
def context_hints(spark, d):
    """What surrounds each line of code that holds the symbol."""
    found = structure.context_hints(code_rows(spark, d, "rs", "swift"), structure.numbers(F.col("lines"), lambda x: F.contains(x, F.lit(SYMBOL))))
    return found.select("path", "line_no", F.array_join(F.transform("hints", lambda h: F.concat_ws(":", h["line"].cast("string"), h["kind"], h["label"])), "|").alias("hints"))


# The rules once more, as patterns of the other engine, written apart from the operator's; S: the symbol, B and E: that it begins and ends there.
RULE_SQL = {
    "rust": {
        "function": "\\bfn SE", "impl_type": "\\bimpl(<[^>]*>)?( [\\w:<>, ]+ for)? (\\w+::)*SE", "trait": "\\btrait SE", "struct": "\\bstruct SE", "enum": "\\benum SE", "macro_call": "BS!",
        "impl_trait_path": "\\bimpl(<[^>]*>)? S::[\\w:]+(<[^>]*>)? for ", "impl_trait": "\\bimpl(<[^>]*>)? S(<[^>]*>)? for ",
    },
    "swift": {
        "function": "\\bfunc SE", "protocol": "\\bprotocol SE", "protocol_member": "^\\s+func S([^\\w$\\{][^\\{]*)?$", "initializer": "\\binit[?!]?\\(([^)]*[^)\\w$])?SE", "class_function": "\\bclass func SE",
        "struct_function": "\\b(mutating|static) func SE", "extension_function": "^\\s+((public|internal|private|fileprivate|open) )?func SE", "actor_function": "\\b(nonisolated|isolated) func SE", "member": "\\.SE", "call": "BS\\(",
        "awaited_call": "\\bawait ([\\w.]+\\.)?S\\(", "attribute": "@SE", "conformance": "\\bextension [\\w.]+ ?: ?([\\w.]+, ?)*SE", "generic_argument": "<([^<>]*[ ,:<])?S([^\\w$<>][^<>]*)?>",
    },
    "ts": {
        "identifier": "BSE", "call": "BS\\(", "method_call": "\\.S\\(", "class": "\\bclass SE", "interface": "\\binterface SE", "interface_type": "\\binterface S ?[<{]", "type_alias": "\\btype SE", "type_alias_type": "\\btype S(<[^>]*>)? ?=",
        "method": "^\\s+((public|private|protected|static|async) )*S\\([^)]*\\)[^;]*\\{", "variable": "\\b(const|let|var) SE", "jsx_element": "<SE", "arrow_variable": "\\b(const|let|var) S([^\\w$].*)?=>",
        "export_value": "\\bexport (default |= ?)SE", "export_specifier": "\\bexport \\{([^}]*[^}\\w$])?S([^\\w$}][^}]*)?\\}", "jsx_attribute": "<[^>]* S=", "satisfies": "BS satisfies ",
    },
    "other": {"identifier": "BSE"},
}
RULE_SQL["tsx"] = RULE_SQL["ts"]
RULE_FILES = {"rust": "ext = 'rs'", "swift": "ext = 'swift'", "ts": "ext = 'ts'", "tsx": "ext = 'tsx'", "other": "ext NOT IN ('rs', 'swift', 'ts', 'tsx')"}


def _rules_sql(languages: tuple[str, ...], symbol: str, table: str) -> str:
    def pattern(p: str) -> str:
        return p.replace("E", "([^\\w$]|$)").replace("B", "(^|[^\\w$])").replace("S", symbol) if symbol.isalnum() else ""

    return " UNION ALL ".join(f"SELECT '{lang}' AS language, '{rule}' AS rule, path, line_no FROM {table} WHERE {RULE_FILES[lang]} AND regexp_matches(line, '{pattern(p)}')" for lang in languages for rule, p in RULE_SQL[lang].items())


query("ast_definitions", f"WITH {CODE_SQL} {_rules_sql(('rust', 'swift', 'tsx'), 'he', 'code')}")(lambda spark, d: structure.rule_matches(code(spark, d), "he", ["rust", "swift", "tsx"]))
query("ast_patterns", f"WITH {CODE_SQL}, everything AS (SELECT path, ext, line_no, line FROM lines WHERE ext NOT IN ('rs', 'swift', 'tsx') UNION ALL SELECT path, ext, line_no, line FROM code), m AS ({_rules_sql(('rust', 'swift', 'ts', 'tsx', 'other'), 'and', 'everything')}) SELECT language, rule, count(*)::BIGINT AS n FROM m GROUP BY language, rule")(
    lambda spark, d: structure.rule_matches(lines(spark, d).where("ext NOT IN ('rs', 'swift', 'tsx')").union(code(spark, d)), "and", ["rust", "swift", "ts", "tsx", "kotlin"]).groupBy("language", "rule").agg(F.count("*").alias("n"))
)
# Structure over several lines: tokens with running sums of brackets, once more in SQL.
def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


BRACKETS_SQL = f"""{BROKEN_SQL}, bodies AS (SELECT path, ext, string_agg(line, chr(10) ORDER BY line_no) AS body FROM broken GROUP BY path, ext),
cut_tokens AS (SELECT path, ext, CASE WHEN ext IN ('ts', 'tsx', 'js', 'jsx') THEN regexp_extract_all(body, '{_text(scopes.QUOTED_TOKENS)}') ELSE regexp_extract_all(body, '{_text(scopes.TOKENS)}') END AS ts FROM bodies),
each_token AS (SELECT path, ext, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM cut_tokens),
summed AS (SELECT *, token IN ('(', '[', '{{') AS opens, token IN (')', ']', '}}') AS closes, 1 + coalesce(sum(length(token) - length(replace(token, chr(10), ''))) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no,
  sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS after_ FROM each_token),
levelled AS (SELECT *, CASE WHEN closes THEN after_ + 1 ELSE after_ END AS level FROM summed),
stream AS (SELECT *, last_value(CASE WHEN opens THEN token END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS around FROM levelled),
shown_tokens AS (SELECT * FROM stream WHERE NOT regexp_matches(token, '^(/[*/]|["`''])'))"""
_DECLARED, _CONTROL = (f"regexp_extract(signature, '^(?:.* )?((?:{'|'.join(words)})(?: .*)?)$', 1)" for words in (scopes.DECLARES, scopes.CONTROLS))
SCOPES_SQL = f"""{BRACKETS_SQL}, parted AS (SELECT *, coalesce(sum((token IN ('{{', '}}') OR token = ';' AND coalesce(around, '{{') = '{{')::INT) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement,
  lead(CASE WHEN token = '}}' THEN line_no END) OVER (PARTITION BY path, level, token IN ('{{', '}}') ORDER BY i) AS end_line FROM shown_tokens WHERE token <> chr(10)),
statements AS (SELECT path, ext, statement, list(token ORDER BY i) AS a, min(line_no) AS first_line, arg_max(line_no, i) AS open_line, arg_max(level, i) AS depth, arg_max({{'e': end_line}}, i).e AS end_line FROM parted GROUP BY path, ext, statement),
opened AS (SELECT *, array_to_string(a[1:len(a) - 1], ' ') AS signature FROM statements WHERE a[-1] = '{{'),
spoken AS (SELECT *, {_DECLARED} AS declared, {_CONTROL} AS control, ext IN ('ts', 'tsx', 'js', 'jsx') AS quoted, regexp_extract(signature, '^(?:.* )?(?:const|let|var) ([\\w$]+) .*= >$', 1) AS arrow,
  regexp_extract(signature, '^(?:.* )?([A-Za-z_$][\\w$]*) (?:< [^()]*> )?\\([^()]*(?:\\([^()]*\\)[^()]*)*\\)[^()=]*$', 1) AS method FROM opened),
worded_scopes AS (SELECT *, regexp_extract(declared, '^(\\S+)', 1) AS word, regexp_replace(regexp_extract(declared, '^\\S+ ?(.*)$', 1), '[A-Za-z_]\\w* : : ', '', 'g') AS rest FROM spoken),
judged_scopes AS (SELECT *, declared = '' OR control <> '' AND length(control) < length(declared) AND NOT (word = 'impl' AND starts_with(control, 'for ')) AS block, method <> '' AND method NOT IN ({', '.join(f"'{w}'" for w in scopes.CONTROLS)}) AS plain, regexp_extract(rest, '(?:^|.* )for (?:& |mut |dyn )*([A-Za-z_]\\w*)', 1) AS target FROM worded_scopes),
scopes AS (SELECT path, ext, CASE WHEN NOT block THEN word WHEN quoted AND arrow <> '' THEN 'arrow' WHEN quoted AND plain THEN 'method' ELSE 'block' END AS kind,
  nullif(CASE WHEN NOT block THEN CASE WHEN word = 'impl' AND target <> '' THEN target WHEN word IN ('init', 'deinit', 'subscript') THEN word ELSE regexp_extract(regexp_replace(rest, '^< [^{{]*?> ([A-Za-z_])', '\\1'), '^([A-Za-z_$][\\w$]*)', 1) END WHEN quoted AND arrow <> '' THEN arrow WHEN quoted AND plain THEN method END, '') AS name,
  signature, first_line::BIGINT AS first_line, open_line::BIGINT AS open_line, end_line::BIGINT AS end_line, depth::BIGINT AS depth FROM judged_scopes)"""


def broken(spark: SparkSession, d: str) -> DataFrame:
    return corpus.broken_code(files(spark, d))


query("code_scopes", f"WITH {SCOPES_SQL} SELECT path, kind, name, signature, first_line, open_line, end_line, depth FROM scopes")(lambda spark, d: scopes.scopes(broken(spark, d)).drop("ext"))


@query(
    "scope_of_hit",
    f"""WITH {SCOPES_SQL}, found AS (SELECT path, line_no FROM broken WHERE contains(line, '{SYMBOL}')),
inner_ AS (SELECT f.path, f.line_no, s.kind, s.name, s.first_line, s.end_line FROM found f JOIN scopes s ON s.path = f.path AND s.kind <> 'block' AND f.line_no BETWEEN s.first_line AND coalesce(s.end_line, 2147483647) QUALIFY row_number() OVER (PARTITION BY f.path, f.line_no ORDER BY s.depth DESC, s.first_line DESC) = 1)
SELECT f.path, f.line_no, kind AS scope_kind, name AS scope_name, first_line AS scope_start, end_line AS scope_end FROM found f LEFT JOIN inner_ i ON f.path = i.path AND f.line_no = i.line_no""",
)
def scope_of_hit(spark, d):
    held = broken(spark, d)
    found = corpus.lines_of(held).where(F.contains("line", F.lit(SYMBOL))).select("path", "line_no")
    return scopes.innermost(found, scopes.scopes(held))


JOINED_SQL = f"""{BRACKETS_SQL}, told_tokens AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY path ORDER BY i), '') AS prior FROM shown_tokens),
lists_ AS (SELECT *, last_value(CASE WHEN token = '{{' THEN prior IN ('export', 'import', 'type') END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY i) AS in_list FROM told_tokens),
going AS (SELECT path, line_no FROM lists_ WHERE token = chr(10) AND (around IN ('(', '[') OR around = '{{' AND coalesce(in_list, FALSE))),
runs_of AS (SELECT b.path, b.ext, b.line_no, b.line, coalesce(sum(CASE WHEN g.path IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.path ORDER BY b.line_no), 0) AS run FROM broken b LEFT JOIN going g ON g.path = b.path AND g.line_no = b.line_no - 1),
joined AS (SELECT path, ext, min(line_no) AS first, string_agg(CASE WHEN line_no = head THEN rtrim(line) ELSE trim(line) END, ' ' ORDER BY line_no) AS line FROM (SELECT *, min(line_no) OVER (PARTITION BY path, run) AS head FROM runs_of) GROUP BY path, ext, run HAVING count(*) > 1)"""


@query(
    "ast_multiline",
    f"""WITH {JOINED_SQL}, whole_runs AS (SELECT path, ext, first AS line_no, line FROM joined), ruled AS ({_rules_sql(('rust', 'swift', 'tsx'), 'he', 'whole_runs')}),
places AS (SELECT r.path, min(r.line_no) OVER (PARTITION BY r.path, r.run) AS first, r.line_no, r.line FROM runs_of r)
SELECT language, rule, r.path, p.line_no FROM ruled r JOIN places p ON p.path = r.path AND p.first = r.line_no WHERE regexp_matches(p.line, '(^|[^\\w$])he([^\\w$]|$)')""",
)
def ast_multiline(spark, d):
    return scopes.broken_matches(broken(spark, d), "he", ["rust", "swift", "tsx"])


CONTEXTS_SQL = f"""WITH {HITS_SQL}, around AS (SELECT path, greatest(1, line_no - 2) AS s, line_no + 2 AS e FROM hits),
fresh AS (SELECT *, CASE WHEN coalesce(max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 < s THEN 1 ELSE 0 END AS new FROM around),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM fresh),
spans AS (SELECT path, min(s) AS s, max(e) AS e, count(*) AS hits FROM numbered GROUP BY path, n)
SELECT l.path, s::BIGINT AS start, max(line_no)::BIGINT AS "end", any_value(hits)::BIGINT AS hits, string_agg(line, chr(10) ORDER BY line_no) AS text FROM spans JOIN lines l ON l.path = spans.path AND l.line_no BETWEEN s AND e GROUP BY l.path, s"""
query("context_ranges", CONTEXTS_SQL)(lambda spark, d: ranges.contexts(hits(spark, d).select("path", "line_no"), lines(spark, d)))
query("collapse_ws", f"WITH {LINES_SQL} SELECT path, line_no, {collapsed('line')} AS value FROM lines")(lambda spark, d: lines(spark, d).select("path", "line_no", structure.collapse(F.col("line")).alias("value")))
query("indentation", f"WITH {CODE_SQL} SELECT path, line_no, (length(line) - length(regexp_replace(line, '^\\s+', '')))::BIGINT AS value FROM code")(lambda spark, d: code(spark, d).select("path", "line_no", structure.indentation(F.col("line")).alias("value")))
query("snippet_default", f"WITH {LINES_SQL} SELECT path, line_no, nullif({collapsed('line')}, '') AS value FROM lines")(lambda spark, d: lines(spark, d).select("path", "line_no", snippets.default(F.col("line")).alias("value")))
STRIPPED_SQL = f"regexp_replace(line, '^{WS}|{WS}$', '', 'g')"
TS_TAGS_SQL = "CASE WHEN s = '' THEN NULL WHEN starts_with(s, '<') THEN x ELSE x || " + " || ".join(
    f"CASE WHEN {t} THEN ' [{n}]' ELSE '' END"
    for t, n in (
        ("contains(s, 'async')", "async"), ("starts_with(s, 'use') OR contains(s, ' = use')", "hook"), ("contains(s, 'React.FC') OR contains(s, 'React.FunctionComponent')", "component"),
        ("contains(s, 'React.forwardRef') OR contains(s, 'React.memo')", "component"), ("contains(s, 'Promise<')", "promise"), ("contains(s, '=>')", "arrow"), ("contains(s, 'await ')", "await"),
        ("contains(s, '<') AND contains(s, '>')", "generic"), ("contains(s, 'satisfies ')", "satisfies"),
    )
) + " END"
query("snippet_ts", f"WITH {CODE_SQL}, t AS (SELECT path, line_no, {collapsed('line')} AS x, {STRIPPED_SQL} AS s FROM code WHERE ext = 'tsx') SELECT path, line_no, {TS_TAGS_SQL} AS value FROM t")(
    lambda spark, d: code(spark, d).where("ext = 'tsx'").select("path", "line_no", snippets.typescript(F.col("line")).alias("value"))
)
ACCESS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '^{w}| {w}[ (]') THEN ' [{w}]'" for w in ("public", "internal", "private", "fileprivate", "open")) + " ELSE '' END"
SWIFT_VALUES_SQL = f"""w AS (SELECT *, regexp_matches(trim(line), '^(extension|struct|class|protocol|actor|enum) ') AS opens, regexp_matches(trim(line), '^(extension|struct|class|protocol|actor|enum) |^(func |init|let |var )') AS stops, {collapsed('line')} AS x FROM code WHERE ext = 'swift'),
u AS (SELECT *, last_value(CASE WHEN stops THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM w),
marks AS (SELECT path, line_no, string_agg(' [' || mark || ']', '' ORDER BY place) AS marks FROM (SELECT u.path, u.line_no, m.x AS mark, min(m.line_no) AS place FROM u JOIN w m ON m.path = u.path AND m.line_no > coalesce(u.stop, 0) AND m.line_no < u.line_no AND starts_with(trim(m.line), '@') GROUP BY u.path, u.line_no, m.x) GROUP BY path, line_no),
swifts AS (SELECT u.path, u.line_no, CASE WHEN u.x = '' THEN NULL ELSE coalesce(c.x || ' :: ', '') || u.x || CASE WHEN contains(u.x, 'async') THEN ' [async]' ELSE '' END || CASE WHEN contains(lower(u.x), 'await ') THEN ' [await]' ELSE '' END || {ACCESS_SQL.replace('lower(x)', 'lower(u.x)')} || CASE WHEN contains(u.x, '<') AND contains(u.x, '>') THEN ' [generic]' ELSE '' END || coalesce(marks, '') END AS value
  FROM u LEFT JOIN w c ON c.path = u.path AND c.line_no = u.stop AND c.opens LEFT JOIN marks m ON m.path = u.path AND m.line_no = u.line_no)"""
query("snippet_swift", f"WITH {CODE_SQL}, {SWIFT_VALUES_SQL} SELECT path, line_no, value FROM swifts")(
    lambda spark, d: structure.swift_surroundings(code_rows(spark, d, "swift")).select("path", "line_no", snippets.swift(F.col("line"), F.col("context"), F.col("marks")).alias("value"))
)


@query(
    "snippet_format",
    f"""WITH {CODE_SQL}, {SWIFT_VALUES_SQL}, every_line AS (SELECT path, ext, line_no, line FROM lines WHERE ext NOT IN ('rs', 'swift', 'tsx') UNION ALL SELECT path, ext, line_no, line FROM code WHERE ext <> 'swift'),
t AS (SELECT path, ext, line_no, {collapsed('line')} AS x, {STRIPPED_SQL} AS s FROM every_line)
SELECT path, line_no, CASE WHEN ext IN ('ts', 'tsx') THEN {TS_TAGS_SQL} ELSE nullif(x, '') END AS value FROM t UNION ALL SELECT path, line_no, value FROM swifts""",
)
def snippet_format(spark, d):
    """Snippets of all lines of all files, each by its language."""
    rest = lines(spark, d).where("ext NOT IN ('rs', 'swift', 'tsx')").union(code(spark, d).where("ext <> 'swift'"))
    none = F.lit(None)
    plain = rest.select("*", none.cast("string").alias("context"), none.cast("array<string>").alias("marks"))
    every = plain.union(structure.swift_surroundings(code_rows(spark, d, "swift")))
    return every.select("path", "line_no", snippets.formatted(F.col("line"), F.col("ext"), F.col("context"), F.col("marks")).alias("value"))


# Index

TOKENS_SQL = FILES_SQL + ", toks AS (SELECT path, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS token FROM files), kept AS (SELECT * FROM toks WHERE strlen(token) < 40)"
query("index_tokens", f"WITH {TOKENS_SQL} SELECT path, count(*)::BIGINT AS dl FROM kept GROUP BY path")(lambda spark, d: index.doc_stats(files(spark, d)).where("dl > 0"))
query("index_postings", f"WITH {TOKENS_SQL} SELECT token, path, count(*)::BIGINT AS tf FROM kept GROUP BY token, path")(lambda spark, d: index.postings(files(spark, d)))
BM25_SQL = (
    TOKENS_SQL
    + """, stats AS (SELECT f.path, count(token) AS dl FROM files f LEFT JOIN kept k ON f.path = k.path GROUP BY f.path), whole AS (SELECT count(*) AS n, avg(dl) AS a FROM stats),
p AS (SELECT token, path, count(*) AS tf FROM kept WHERE token IN ('elle', 'und', 'with') GROUP BY token, path), df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
ranked AS (SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS bm25 FROM p JOIN df USING (token) JOIN stats USING (path), whole GROUP BY path)"""
)


def ranked_files(spark: SparkSession, d: str) -> DataFrame:
    return index.bm25(files(spark, d), "und elle with")


query("index_bm25", f"WITH {BM25_SQL} SELECT path, floor(bm25 * 10000 + 0.5) / 10000 AS bm25 FROM ranked")(lambda spark, d: ranked_files(spark, d).select("path", (F.floor(F.col("bm25") * 10000 + 0.5) / 10000).alias("bm25")))


@query("probe_indexed", f"WITH {BM25_SQL}, best AS (SELECT path FROM ranked ORDER BY bm25 DESC, path LIMIT 20), {LINES_SQL.replace(FILES_SQL + ', ', '')} SELECT path, line_no FROM lines WHERE path IN (SELECT path FROM best) AND contains(line, 'with')")
def probe_indexed(spark, d):
    f = files(spark, d)
    best = index.best(index.bm25(f, "und elle with"), 20)
    return search.probe(f.join(best.select("path"), "path", "left_semi"), "with").select("path", "line_no")


# Postings with their places, and what phrases and groups of the query syntax ask of them.
PLACES_SQL = FILES_SQL + """, cut AS (SELECT path, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS a FROM files), placed AS (SELECT path, generate_subscripts(a, 1) AS pos, unnest(a) AS token FROM cut),
kept AS (SELECT * FROM placed WHERE strlen(token) < 40), stats AS (SELECT f.path, count(token) AS dl FROM files f LEFT JOIN kept k ON f.path = k.path GROUP BY f.path), whole AS (SELECT count(*) AS n, avg(dl) AS a FROM stats),
tf AS (SELECT token, path, count(*) AS tf FROM kept GROUP BY token, path), idf AS (SELECT token, any_value(ln(1 + (n - c + 0.5) / (c + 0.5))) AS idf FROM (SELECT token, count(*) AS c FROM tf GROUP BY token), whole GROUP BY token)"""


def _word_sql(name: str, word: str, weight: float = 1.0) -> str:
    return f"{name} AS (SELECT path, {weight} * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM tf JOIN idf USING (token) JOIN stats USING (path), whole WHERE token = '{word}')"


def _phrase_sql(name: str, *words: str) -> str:
    """Files where the words stand in a row, scored by how often; the idf of a phrase is the sum of its words'."""
    joins = " ".join(f"JOIN kept k{i} ON k{i}.path = k0.path AND k{i}.pos = k0.pos + {i} AND k{i}.token = '{w}'" for i, w in enumerate(words) if i)
    idf = " + ".join(f"coalesce((SELECT idf FROM idf WHERE token = '{w}'), ln(1 + (n + 0.5) / 0.5))" for w in words)
    return f"{name} AS (SELECT path, ({idf}) * pf * 2.2 / (pf + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM (SELECT k0.path, count(*) AS pf FROM kept k0 {joins} WHERE k0.token = '{words[0]}' GROUP BY k0.path) JOIN stats USING (path), whole)"


ROUNDED_SQL = "SELECT path, floor(round(s, 6) * 10000 + 0.5) / 10000 AS bm25"


def _asked(text: str):
    def run(spark, d):
        return index.bm25(files(spark, d), text).select("path", (F.floor(F.col("bm25") * 10000 + 0.5) / 10000).alias("bm25"))

    return run


query("index_phrase", f"""WITH {PLACES_SQL}, {_phrase_sql("p1", "the", "anea", "eriner")}, {_phrase_sql("p2", "de", "la")}, both_ AS (SELECT path, s FROM p1 UNION ALL SELECT path, s FROM p2), t AS (SELECT path, sum(s) AS s FROM both_ GROUP BY path) {ROUNDED_SQL} FROM t""")(
    _asked('"the anea eriner" "de  la"')
)
query(
    "index_boolean",
    f"""WITH {PLACES_SQL}, {_word_sql("x", "und")}, {_word_sql("y", "the")}, {_word_sql("z", "and", 2.5)}, {_word_sql("o", "of")}, {_phrase_sql("p", "the", "is")}, {_word_sql("q", "is")},
u AS (SELECT f.path, x.s AS xs, y.s AS ys, z.s AS zs, o.s AS os, p.s AS ps, q.s AS qs FROM files f LEFT JOIN x USING (path) LEFT JOIN y USING (path) LEFT JOIN z USING (path) LEFT JOIN o USING (path) LEFT JOIN p USING (path) LEFT JOIN q USING (path)),
t AS (SELECT path, coalesce(CASE WHEN ys IS NOT NULL AND zs IS NOT NULL AND os IS NULL THEN ys + zs END, 0) + coalesce(CASE WHEN xs IS NOT NULL AND ps IS NULL THEN xs + coalesce(qs, 0) END, 0) AS s FROM u
  WHERE ys IS NOT NULL AND zs IS NOT NULL AND os IS NULL OR xs IS NOT NULL AND ps IS NULL) {ROUNDED_SQL} FROM t""",
)(_asked('(the AND and^2.5 AND NOT of) OR (+und is -"the is")'))
query("index_range", f"WITH {PLACES_SQL}, r AS (SELECT DISTINCT path FROM kept WHERE token >= 'el' AND token < 'em'), {_word_sql('w', 'le')}, t AS (SELECT r.path, 1.0 + coalesce(w.s, 0) AS s FROM r LEFT JOIN w USING (path) UNION ALL SELECT path, s FROM w WHERE path NOT IN (SELECT path FROM r)) {ROUNDED_SQL} FROM t")(
    _asked("body:[el TO em} le")
)


@query("index_topk", f"WITH {BM25_SQL} SELECT path, floor(bm25 * 10000 + 0.5) / 10000 AS bm25 FROM ranked ORDER BY ranked.bm25 DESC, path LIMIT 10")
def index_topk(spark, d):
    """The ten best files, read from the ranges that can hold them."""
    f, folder = files(spark, d), shared_folder(spark, "topk")
    topk.write(index.sized_postings(f), folder, index.doc_stats(f))
    n, total = spark.read.parquet(f"{folder}/ranges").agg(F.count("*"), F.sum("dl")).first()
    return topk.top(spark, folder, "und elle with", 10, n, total).select("path", (F.floor(F.col("bm25") * 10000 + 0.5) / 10000).alias("bm25"))


@query("index_refresh", f"WITH {TOKENS_SQL} SELECT token, count(*)::BIGINT AS files, sum(tf)::BIGINT AS places FROM (SELECT token, path, count(*) AS tf FROM kept GROUP BY token, path) GROUP BY token")
def index_refresh(spark, d):
    """An index of an older tree that follows the tree of now: a third of the files is new, a third has changed, some have gone."""
    f = files(spark, d)
    old = f.where("doc_id % 3 <> 0").withColumn("body", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("older words "), "body")).otherwise(F.col("body")))
    gone = f.where("doc_id % 5 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    kept = index.Index(spark, shared_folder(spark, "index"))
    kept.refresh(old.union(gone))
    kept.refresh(f)
    return kept.live().groupBy("token").agg(F.count("*").alias("files"), F.sum(F.size("positions")).cast("long").alias("places"))


@query("rga_fallback", "WITH t AS (SELECT url, string_split(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10) || '+', chr(10), 'g'), chr(10)) AS a FROM pages), c AS (SELECT url, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM t), l AS (SELECT url, generate_subscripts(a, 1)::BIGINT AS line_no, unnest(a) AS line FROM c) SELECT url, line_no, 0.9::DOUBLE AS score FROM l WHERE regexp_matches(line, 'th[ae]t')")
def rga_fallback(spark, d):
    return corpus.page_lines(spark, d).where(F.rlike("line", F.lit("th[ae]t"))).select("url", "line_no", F.lit(0.9).alias("score"))


# State

RANKED20_SQL = f"{SCORED_SQL}, ranked AS (SELECT {RANK_SQL}::BIGINT AS rank, path FROM scored ORDER BY 1 LIMIT 20)"


def ranked20(spark: SparkSession, d: str) -> DataFrame:
    return search.top_hits(scored(spark, d), 20)


@query("observe_dirs", f"WITH {RANKED20_SQL}, whole AS (SELECT 'src1' AS dir, 3 AS score UNION ALL SELECT 'gone', 1 UNION ALL SELECT string_split(path, '/')[1], 1 FROM ranked) SELECT dir, sum(score)::BIGINT AS score FROM whole GROUP BY dir")
def observe_dirs(spark, d):
    return state.observe_directories(ranked20(spark, d), spark.createDataFrame([("src1", 3), ("gone", 1)], "dir string, score long"))


@query("observe_symbol", f"WITH {RANKED20_SQL}, whole AS (SELECT 'old/a.rs' AS path, 0 AS new, 1 AS pos UNION ALL SELECT path, 1, rank FROM ranked WHERE rank <= 10), first AS (SELECT path, min(new * 1000 + pos) AS o FROM whole GROUP BY path ORDER BY o, path LIMIT 10) SELECT '{SYMBOL}' AS symbol, path, row_number() OVER (ORDER BY o, path)::BIGINT AS pos FROM first")
def observe_symbol(spark, d):
    return state.observe_symbol(ranked20(spark, d), spark.createDataFrame([(SYMBOL, "old/a.rs", 1)], "symbol string, path string, pos long"), SYMBOL)


@query("state_hints", f"WITH {FILES_SQL} SELECT path, doc_id AS pos FROM files WHERE doc_id % 2 = 0")
def state_hints(spark, d):
    f = files(spark, d)
    known = f.where("doc_id % 2 = 0").select(F.lit(SYMBOL).alias("symbol"), "path", F.col("doc_id").alias("pos"))
    gone = f.select(F.lit(SYMBOL).alias("symbol"), F.concat(F.lit("gone/"), "name").alias("path"), F.col("doc_id").alias("pos"))
    return state.live_hints(known.union(gone), f, SYMBOL)


query("evict_directories", f"WITH {HITS_SQL} SELECT path AS dir, count(*)::BIGINT AS score FROM hits GROUP BY path ORDER BY score DESC, dir LIMIT 200")(
    lambda spark, d: state.evict_directories(hits(spark, d).groupBy(F.col("path").alias("dir")).agg(F.count("*").alias("score")))
)
query("evict_symbols", f"WITH {TOKENS_SQL}, s AS (SELECT token AS symbol, max(doc_id) AS last_seen FROM kept JOIN files USING (path) GROUP BY token) SELECT symbol, last_seen FROM s ORDER BY last_seen DESC, symbol LIMIT 500")(
    lambda spark, d: state.evict_symbols(files(spark, d).select("doc_id", F.explode(index.tokens(F.col("body"))).alias("symbol")).groupBy("symbol").agg(F.max("doc_id").alias("last_seen")))
)


@query(
    "state_replay",
    """WITH found AS (SELECT event_type AS symbol, 'd' || user_id % 7 || '/' || user_id AS path, ts FROM events), first AS (SELECT symbol, path, min(ts) AS ts FROM found GROUP BY symbol, path QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY min(ts), path) <= 10)
SELECT symbol, string_agg(path, ',' ORDER BY ts, path) AS paths FROM first GROUP BY symbol""",
)
def state_replay(spark, d):
    """Events as a stream of found paths: the keyed state that a replay leaves."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events_ = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    found = events_.select(F.col("event_type").alias("symbol"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"), "ts")
    folder = shared_folder(spark, "state")
    streams.follow(streams.symbol_states(found), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return streams.symbols_now(spark, f"{folder}/rows").select("symbol", F.array_join("paths", ",").alias("paths"))


# Benchmarks and metrics


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark runs: type as scenario, value as milliseconds, even users as successes."""
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.col("value").alias("ms"), (F.col("user_id") % 2 == 0).alias("ok"), "ts")


RUNS_SQL = "runs AS (SELECT event_type AS name, value AS ms, user_id % 2 = 0 AS ok, ts FROM events)"
REPORT_SQL = "count(*)::BIGINT AS iterations, round(avg(ms), 4) AS mean_ms, round(avg(ok::INT), 4) AS success_rate"


def report(spark: SparkSession, d: str) -> DataFrame:
    out = observe.scenario_report(runs(spark, d))
    return out.select("name", "iterations", F.round("mean_ms", 4).alias("mean_ms"), F.round("success_rate", 4).alias("success_rate"), "qps")


query("bench_scenarios", f"WITH {RUNS_SQL} SELECT name, {REPORT_SQL} FROM runs GROUP BY name")(lambda spark, d: report(spark, d).where("name IS NOT NULL").drop("qps"))
query("bench_totals", f"WITH {RUNS_SQL} SELECT {REPORT_SQL}, round(1000 / avg(ms), 4) AS qps FROM runs")(lambda spark, d: report(spark, d).where("name IS NULL").select("iterations", "mean_ms", "success_rate", F.round("qps", 4).alias("qps")))
query("bench_gate", f"WITH {RUNS_SQL}, r AS (SELECT name, avg(ms) AS m, avg(ok::INT) AS s FROM runs GROUP BY name) SELECT name, m > 20 AS too_slow, s < 0.99 AS too_wrong, m <= 20 AND s >= 0.99 AS passes FROM r")(lambda spark, d: observe.gate(report(spark, d)))
query(
    "latency_p95",
    f"WITH {RUNS_SQL}, g AS (SELECT name, count(*) AS n, avg(ms) AS m, min(ms) AS lo, max(ms) AS hi, list_sort(list(ms)) AS s FROM runs GROUP BY name), p AS (SELECT *, (n + 1) * 0.95::DOUBLE AS k FROM g) SELECT name, n::BIGINT AS n, round(m, 4) AS mean_ms, lo AS min_ms, hi AS max_ms, round(CASE WHEN n < 20 THEN hi ELSE s[floor(k)::INT] + (s[least(floor(k)::INT + 1, n)] - s[floor(k)::INT]) * (k - floor(k)) END, 4) AS p95_ms FROM p",
)(lambda spark, d: observe.latency_summary(runs(spark, d)).select("name", "n", F.round("mean_ms", 4).alias("mean_ms"), "min_ms", "max_ms", F.round("p95_ms", 4).alias("p95_ms")))


@query("stage_summary", "WITH s AS (SELECT 'probe' AS stage, value AS ms FROM events UNION ALL SELECT 'verify', value * 2 FROM events) SELECT stage, count(*)::BIGINT AS n, round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms FROM s GROUP BY stage")
def stage_summary(spark, d):
    held = runs(spark, d).select(F.col("ms").alias("probe"), (F.col("ms") * 2).alias("verify"))
    return observe.stage_summary(held, ["probe", "verify"]).withColumn("mean_ms", F.round("mean_ms", 4))


query("bench_latest", f"WITH {RUNS_SQL} SELECT name, ms, ts FROM runs QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, ms DESC) = 1")(
    lambda spark, d: observe.latest(runs(spark, d).select("name", F.struct("ts", "ms").alias("k"), "ms", "ts"), "name", "k").select("name", "ms", "ts")
)


@query("bench_success", "SELECT doc_id::VARCHAR AS name, quality = 1 AS ok FROM labels")
def bench_success(spark, d):
    """Labels as expectations: good documents expect their own file at rank 1, the others a file that isn't there."""
    f = files(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("name"), "path", F.element_at(F.split("path", "/"), -1).alias("last"))
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    found = f.select("name", "path", F.lit(1).cast("long").alias("line_no"), F.lit(1).cast("long").alias("rank"))
    none = F.lit(None).cast("long")
    expected = f.join(labels, "doc_id").select("name", F.when(F.col("quality") == 1, F.col("last")).otherwise(F.lit("absent.rs")).alias("path"), none.alias("line_no"), none.alias("top_n"))
    return observe.expectation_met(found, expected)


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


HIST_SQL = "hist AS (" + " UNION ALL ".join(f"SELECT event_type AS label, '{b}' AS le, count(*) FILTER (value <= {b})::BIGINT AS cumulative FROM events WHERE value > 0 GROUP BY 1" for b in observe.BUCKETS) + " UNION ALL SELECT event_type, '+Inf', count(*)::BIGINT FROM events WHERE value > 0 GROUP BY 1)"
query("metrics_counters", "SELECT event_type AS label, count(*)::BIGINT AS total FROM events GROUP BY 1")(lambda spark, d: observe.counters(events(spark, d), "event_type"))
query("metrics_histogram", f"WITH {HIST_SQL} SELECT label, le, cumulative FROM hist")(lambda spark, d: observe.histogram(events(spark, d), "event_type", "value"))
EXPORT_SQL = f"""WITH {HIST_SQL}, counted AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1),
sums AS (SELECT event_type AS label, round(sum(value), 3)::DECIMAL(30, 3) AS s, count(*) AS n FROM events WHERE value > 0 GROUP BY 1),
parts(part, label, place, line) AS (SELECT 0, '', 0, '# HELP events_total Events by label.' UNION ALL SELECT 0, '', 1, '# TYPE events_total counter' UNION ALL SELECT 1, '', 0, '# HELP stage_latency Values by label.' UNION ALL SELECT 1, '', 1, '# TYPE stage_latency histogram'
  UNION ALL SELECT 0, label, 2, 'events_total{{label="' || label || '"}} ' || n FROM counted
  UNION ALL SELECT 1, label, 3 + list_position([{', '.join(f"'{b}'" for b in (*observe.BUCKETS, '+Inf'))}], le), 'stage_latency_bucket{{label="' || label || '",le="' || le || '"}} ' || cumulative FROM hist
  UNION ALL SELECT 1, label, 100, 'stage_latency_sum{{label="' || label || '"}} ' || s FROM sums UNION ALL SELECT 1, label, 101, 'stage_latency_count{{label="' || label || '"}} ' || n FROM sums)
SELECT row_number() OVER (ORDER BY part, label, place)::BIGINT AS line_no, line FROM parts"""
query("metrics_export", EXPORT_SQL)(lambda spark, d: observe.exposition(events(spark, d), "event_type", "value", "events_total", "stage_latency"))
query("bench_gap", f"WITH {RUNS_SQL}, s AS (SELECT (SELECT avg(ms) FROM runs WHERE name = 'purchase') - (SELECT avg(ms) FROM runs WHERE name = 'click') AS gap) SELECT round(gap, 3) AS gap_ms, gap <= 6 AS passes FROM s")(
    lambda spark, d: observe.gap(report(spark, d), "click", "purchase").withColumn("gap_ms", F.round("gap_ms", 3))
)
query("telemetry_windows", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type AS label, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(
    lambda spark, d: telemetry.windowed_counts(events(spark, d), "event_type", "value").withColumn("total", F.round("total", 2))
)

# Whole searches


@query("search_literal", f"WITH {HITS_SQL}, r AS (SELECT row_number() OVER (ORDER BY path, line_no)::BIGINT AS rank, * FROM hits) SELECT rank, path, line_no, 0.95::DOUBLE AS score, 'rg-global' AS origin, trim(regexp_replace(snippet, '{WS}', ' ', 'g')) AS snippet, 'inspect ' || path || ':' || line_no AS action FROM r WHERE rank <= 5")
def search_literal(spark, d):
    """The fast path: a literal symbol is probed everywhere; hits are scored, made single, ranked, and turned into actions."""
    best = search.top_hits(search.best_per_line(search.score(hits(spark, d)).withColumn("stage", F.lit(0))))
    return best.select("rank", "path", "line_no", "score", "origin", structure.collapse(F.col("snippet")).alias("snippet"), F.concat(F.lit("inspect "), "path", F.lit(":"), F.col("line_no").cast("string")).alias("action"))


@query("search_staged", f"WITH {LINES_SQL}, {CANDIDATES_SQL}, {SCOPED_SQL}, staged AS (SELECT 0 AS stage, path, line_no FROM lines WHERE contains(line, 'ention') AND path IN (SELECT path FROM scoped WHERE FALSE) UNION ALL SELECT 1, path, line_no FROM lines WHERE contains(line, 'ention')) SELECT path, line_no, 0.95::DOUBLE AS score FROM staged WHERE stage = (SELECT min(stage) FROM staged)")
def search_staged(spark, d):
    """Stages in one plan: hits carry their stage, and those of the first stage with any remain."""
    f = files(spark, d)
    none = candidates(spark, d).where("FALSE")
    scoped = search.as_hits(search.probe(search.scoped(f, none, 20), "ention"), "rg-scoped").withColumn("stage", F.lit(0))
    everywhere = search.as_hits(search.probe(f, "ention"), "rg-global").withColumn("stage", F.lit(1))
    return search.score(search.first_stage(scoped.union(everywhere))).select("path", "line_no", F.round("score", 6).alias("score"))


def batch_symbols(spark: SparkSession, d: str) -> DataFrame:
    """All words of the benchmark texts, all pairs of neighbouring ones, and fixed names: literal symbols and others."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.split("text", " ").alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).alias("symbol"))
    return symbols(spark, d).union(pairs.where("trim(symbol) <> ''")).select(F.trim("symbol").alias("symbol")).distinct()


WANTED_SQL = (
    SYMBOLS_SQL.replace("symbols AS (", "plain_symbols AS (")
    + """, pair_words AS (SELECT string_split(text, ' ') AS w FROM benchmark), symbols AS (SELECT DISTINCT trim(symbol) AS symbol FROM (SELECT symbol FROM plain_symbols UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pair_words) WHERE trim(symbol) <> '')"""
)
CASED_SQL = f"""WITH {HINTS_SQL.replace(SYMBOLS_SQL, WANTED_SQL)}, {LINES_SQL}, cased AS (SELECT symbol, NOT regexp_matches(symbol || hint, '\\p{{Lu}}') AS fold FROM hinted),
low AS (SELECT path, ext, line_no, line, lower(line) AS folded FROM lines),
held AS (SELECT symbol, path, ext, line_no, line FROM cased JOIN low ON NOT fold AND contains(line, symbol) UNION ALL SELECT symbol, path, ext, line_no, line FROM cased JOIN low ON fold AND contains(folded, lower(symbol)))"""
query("batch_probe", f"{CASED_SQL} SELECT symbol, count(*)::BIGINT AS lines, count(DISTINCT path)::BIGINT AS files, min(path) AS first_path FROM held GROUP BY symbol")(
    lambda spark, d: batch.batch_counts(files(spark, d), batch_symbols(spark, d))
)


@query(
    "batch_search",
    f"""{CASED_SQL}, capped AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY symbol, path ORDER BY line_no) <= 20),
judged AS (SELECT symbol, path, line_no, regexp_matches(symbol, '^[A-Za-z0-9_]+$') AS literal FROM capped),
cand AS (SELECT symbol, path FROM (SELECT DISTINCT symbol FROM judged WHERE NOT literal) JOIN files ON CASE WHEN regexp_matches(symbol, '^[A-Za-z0-9_.]+$') THEN regexp_matches(name, symbol) ELSE contains(name, symbol) END QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY path) <= 20),
inside AS (SELECT j.* FROM judged j WHERE NOT literal AND (EXISTS (SELECT 1 FROM cand c WHERE c.symbol = j.symbol AND c.path = j.path) OR NOT EXISTS (SELECT 1 FROM cand c WHERE c.symbol = j.symbol))),
solved AS (SELECT symbol, path, line_no, 'rg-global' AS stage, 0.95::DOUBLE AS score FROM judged WHERE literal UNION ALL SELECT symbol, path, line_no, 'rg-scoped', CASE WHEN EXISTS (SELECT 1 FROM cand c WHERE c.symbol = i.symbol AND c.path = i.path) THEN 1.2 ELSE 1.0 END FROM inside i
  UNION ALL SELECT symbol, path, line_no, 'rg-global', 0.95 FROM judged j WHERE NOT literal AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.symbol = j.symbol))
SELECT symbol, stage, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 6) DESC, path, line_no)::BIGINT AS rank, path, line_no, round(score, 6) AS score FROM solved QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 6) DESC, path, line_no) <= 5""",
)
def batch_search(spark, d):
    """A search for each of many symbols: one pass over the bodies, stages by symbol, the best hits of each."""
    found = batch.top_of_each(batch.batch_search(files(spark, d), batch_symbols(spark, d), best=5))
    return found.select("symbol", "stage", "rank", "path", "line_no", F.round("score", 6).alias("score"))
