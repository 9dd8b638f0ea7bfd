"""The library's search: a specification in, one summary out.

    summary = search(spark, SearchSpec("login_user", root="/src", language="rust"))

Stages run in order, and the next one only where the one before found nothing: a literal symbol is probed everywhere at
once; others first in candidate files, then everywhere, in the best files of the index, and in rich documents. Plans stay
lazy until a stage must be known to be empty.
"""

from __future__ import annotations

import json
import logging
import math
import os
import re
import threading
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import rewrite, snippets
from siftwell.operators import index, scopes, search as ops, structure
from siftwell.operators.state import State
from siftwell.sources.corpus import tree_files, tree_pages

log = logging.getLogger("siftwell")
LONGEST_SYMBOL = 256
# Names under which a request may turn a tool on or off.
FLAGS = {
    "use_names": ("fd", "use-fd", "use_fd", "enable_fd"), "use_structure": ("ast-grep", "ast_grep", "use-ast-grep", "use_ast_grep"),
    "use_index": ("index", "enable_index", "enable-index", "use_index"), "use_pages": ("rga", "enable_rga", "enable-rga", "use_rga"), "body": ("body", "fetch_body", "include_body"),
}
# Where a request's folders have other names here.
FOLDERS = {"cache_dir": "state_path"}


@dataclass(frozen=True)
class SearchSpec:
    """What to search for and how. Bad values raise ValueError."""

    symbol: str
    root: str = "."
    language: str | None = None
    timeout_secs: float = 60.0
    max_matches: int = 20
    context_before: int = 0
    context_after: int = 0
    body: bool = False
    use_index: bool = False
    use_pages: bool = False
    use_names: bool = True
    use_structure: bool = True
    state_path: str | None = None
    log_dir: str | None = None
    index_dir: str | None = None
    telemetry: bool = True

    def __post_init__(self):
        symbol = self.symbol.strip()
        if not symbol:
            raise ValueError("symbol is required")
        if len(symbol.encode()) > LONGEST_SYMBOL:
            raise ValueError(f"symbol is longer than {LONGEST_SYMBOL} bytes")
        object.__setattr__(self, "symbol", symbol)
        object.__setattr__(self, "max_matches", max(1, self.max_matches))

    @classmethod
    def from_request(cls, request: dict, defaults: SearchSpec | None = None) -> SearchSpec:
        """A request's values over a server's. Tools are turned on and off by any of their names, as values of their own or in
        tool_flags (or tools); a disable_ prefix turns off; unknown names are ignored.

        A folder that a request names is taken only if it lies below the server's own of that kind, for it is written to.
        """
        base = dict(defaults.__dict__) if defaults else {}
        request = {**request, **{own: request[name] for name, own in FOLDERS.items() if name in request and own not in request}}
        for folder in ("state_path", "index_dir", "log_dir"):
            if defaults is not None and request.get(folder):
                top = base.get(folder)
                path = os.path.realpath(os.path.join(top or "", request[folder]))
                if not top or os.path.commonpath([path, os.path.realpath(top)]) != os.path.realpath(top):
                    raise ValueError(f"{folder} is not below the server's")
                request[folder] = path
        # Over the wire 0 and an empty text stand for "not given".
        known = {k: v for k, v in request.items() if k in cls.__dataclass_fields__ and v not in (None, "", 0) or v is False}
        known = {k: v for k, v in known.items() if k in cls.__dataclass_fields__}
        if base.get("root") and known.get("root") and not os.path.isabs(known["root"]):
            known["root"] = os.path.join(base["root"], known["root"])
        every = {n for names in FLAGS.values() for n in names}
        asked = {**(request.get("tools") or {}), **(request.get("tool_flags") or {})}
        asked |= {n: on for n, on in request.items() if n.lower().removeprefix("disable_") in every and isinstance(on, bool)}
        for name, on in asked.items():
            name = name.lower()
            bare = re.sub("^disable[-_]", "", name)
            for flag, names in FLAGS.items():
                if bare in names:
                    known[flag] = bool(on) != (bare != name)
        return cls(**base | known)

    @property
    def literal(self) -> bool:
        return self.symbol.isascii() and self.symbol.replace("_", "a").isalnum()

    @property
    def languages(self) -> list[str]:
        """Languages that the hint stands for."""
        text = (self.language or "").strip().lower()
        if text.startswith("auto-"):
            text = text[5:].replace("-", "+")
        parts = [p.strip() for p in text.replace("|", "+").replace(",", "+").split("+") if p.strip()]
        return list(dict.fromkeys(x for p in parts for x in rewrite.TOKENS.get(p, (p,))))


@dataclass
class Summary:
    symbol: str
    queries: list[str]
    top_hits: list[dict]
    next_actions: list[str]
    metrics: dict[str, float]
    languages: dict[str, int]
    deduped: int
    stage: str
    stage_ms: dict[str, int]
    warnings: list[str] = field(default_factory=list)
    cycle_ms: int = 0
    startup_ms: int = 0
    auto_expanded_context: bool = False
    language_metrics: dict[str, dict[str, int]] = field(default_factory=dict)

    def to_json(self) -> str:
        """JSON without empty and false values."""

        def full(x):
            if isinstance(x, dict):
                return {k: full(v) for k, v in x.items() if v not in (None, False, "", 0, [], {})}
            return [full(v) for v in x] if isinstance(x, list) else x

        return json.dumps(full(self.__dict__), default=str)


class Engine:
    """Searches one corpus of files; remembers hits for the next search. With index_dir the index is opened there, and built
    if there is none; without it the postings are made for the search."""

    def __init__(self, spark: SparkSession, files: DataFrame, pages: DataFrame | None = None, state_path: str | None = None, index_dir: str | None = None):
        began = time.monotonic()
        self.spark, self.files, self.pages, self.state_path, self.index_dir = spark, files, pages, state_path, index_dir
        self.state = State.load(state_path) if state_path else State()
        self.seen: set[tuple[str, int]] = set()
        self.startup_ms = math.ceil((time.monotonic() - began) * 1000)

    def candidates(self, spec: SearchSpec) -> DataFrame:
        """(path, src_rank, pos): files to look in first. Files named like the symbol, files it was found in before, the first
        files of popular directories, and a Swift package's layout; each file once, by its first source."""
        extensions = rewrite.extensions_of(spec.languages)
        eligible = self.files.where(F.col("ext").isin(extensions)) if extensions else self.files
        first = Window.orderBy("path")

        def table(rows: list[tuple], schema: str) -> DataFrame:
            return self.spark.createDataFrame(rows, schema)

        named = ops.by_name(eligible, _needle(spec.symbol)) if spec.use_names else eligible.where("false").select("path")
        hints = table([(p, i) for i, p in enumerate(self.state.symbol_hits.get(spec.symbol, []))], "path string, pos long")
        scores = table(list(self.state.directory_scores.items()), "dir string, score long")
        entries = ops.directory_entries(eligible, ops.top_directories(scores))
        sources = [
            named.withColumn("pos", F.row_number().over(first)),
            eligible.select("path").join(hints, "path"),
            entries.join(scores, "dir").withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "dir", "pos"))),
        ]
        if "swift" in spec.languages:
            sources.append(ops.swift_layout(eligible).withColumn("pos", F.row_number().over(Window.orderBy("level", "path"))))
        return ops.ordered_union(*sources)

    def _indexed(self, spec: SearchSpec) -> DataFrame | None:
        """The index's best files for the symbol, of the languages asked for; none where the symbol is no query.

        The index holds all files, whatever a search asks for, and follows them: only what is new or has changed since it
        was last opened is read.
        """
        try:
            if self.index_dir:
                kept = index.Index(self.spark, self.index_dir)
                kept.refresh(self.files)
                found = kept.matches(spec.symbol)
            else:
                found = index.bm25(self.files, spec.symbol)
        except index.QueryError as e:
            self._warnings.append(f"rg-indexed: {e}")
            return None
        extensions = rewrite.extensions_of(spec.languages)
        if extensions:
            found = found.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(extensions))
        return index.best(found, spec.max_matches)

    def _stages(self, spec: SearchSpec):
        """(name, hits, candidates) lazily, in order."""
        files, s = self.files, spec.symbol
        fold = rewrite.insensitive(s, (spec.languages or [None])[0])

        def hits(held: DataFrame, origin: str, fold: bool = fold) -> DataFrame:
            return ops.as_hits(ops.capped_probe(held, s, spec.max_matches, fold), origin)

        if spec.literal:
            yield "rg-global", hits(files, "rg-global"), None
        cands = self.candidates(spec).persist()
        self._held.append(cands)
        scope = files if cands.isEmpty() else ops.scoped(files, cands, spec.max_matches)
        yield "rg-scoped", hits(scope, "rg-scoped"), cands
        if not spec.literal:
            yield "rg-global", hits(files, "rg-global"), cands
        if spec.use_index and (best := self._indexed(spec)) is not None:
            yield "rg-indexed", hits(files.join(F.broadcast(best.select("path")), "path", "left_semi"), "rg-indexed", True), cands
        if spec.use_pages and self.pages is not None:
            found = self.pages.where(F.rlike("line", F.lit(s))).orderBy("url", "line_no").limit(spec.max_matches)
            yield "rga", ops.as_hits(found.select(F.col("url").alias("path"), F.lit(None).cast("string").alias("ext"), "line_no", "line"), "rga"), cands

    def search(self, spec: SearchSpec) -> Summary:
        """Runs stages until one finds something, then scores, ranks and enriches its best hits. A stage that Spark fails, as
        one whose pattern is none or that takes too long, is a warning, not an error."""
        self._held: list[DataFrame] = []
        try:
            return self._search(spec)
        finally:
            for df in self._held:
                df.unpersist()

    def _search(self, spec: SearchSpec) -> Summary:
        warnings, times = list(self.state.warnings), {}
        self._warnings = warnings
        language = (spec.languages or [None])[0]
        held, stage, cands = None, "", None
        for name, hits, candidates in self._stages(spec):
            began = time.monotonic()
            hits = hits.persist()
            self._held.append(hits)
            try:
                with _limit(self.spark, spec.timeout_secs):
                    found = not hits.isEmpty()
            except (PySparkException, Py4JError) as e:
                warnings.append(f"{name}: {str(e).splitlines()[0][:200]}")
                found = False
            times[name] = int((time.monotonic() - began) * 1000)
            log.info("stage", extra={"stage": name, "found": found, "ms": times[name], "symbol": spec.symbol})
            if found:
                held, stage, cands = hits, name, candidates
                break
        queries = [r.query for r in rewrite.rewritten(self.spark.createDataFrame([(spec.symbol,)], "symbol string"), language).orderBy("pos").collect()]
        if held is None:
            return Summary(spec.symbol, queries, [], [], dict.fromkeys(("precision", "density", "clustering", "reward"), 0.0), {}, 0, "", times, warnings, sum(times.values()), self.startup_ms)
        began = time.monotonic()
        rules = None
        # The fast path of a literal symbol goes without structure.
        if spec.use_structure and not (spec.literal and stage == "rg-global") and re.fullmatch(r"[A-Za-z0-9_$]+", spec.symbol):
            paths = self.files.join(held.select("path").distinct(), "path", "left_semi")
            asked = spec.languages or ["rust"]
            found = scopes.all_matches(paths, ops.probe(paths, spec.symbol), spec.symbol, asked)
            rules = structure.first_matches(found, spec.max_matches).persist()
            self._held.append(rules)
            times["disambiguate"] = int((time.monotonic() - began) * 1000)
        began = time.monotonic()
        scored = ops.best_per_line(ops.score(held, cands, rules).withColumn("stage", F.lit(0)))
        if self.seen:
            scored = ops.unseen(scored, self.spark.createDataFrame(sorted(self.seen), "path string, line_no long"))
        scored = scored.persist()
        self._held.append(scored)
        n_rules = rules.select("path", "line_no").distinct().count() if rules is not None else 0
        n_cands = cands.count() if cands is not None else 0
        metrics = ops.metrics(scored, F.lit(n_rules), F.lit(n_cands)).first().asDict()
        top = [r.asDict(recursive=True) for r in self._shown(spec, ops.top_hits(scored)).orderBy("rank").collect()]
        staged = scored.select("ext", F.lit("verify").alias("stage")).union(held.select("ext", F.lit("probe").alias("stage")))
        if cands is not None:
            staged = staged.union(self.files.join(cands.select("path"), "path", "left_semi").select("ext", F.lit("discover").alias("stage")))
        if rules is not None:
            matched = scored.join(rules.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi")
            staged = staged.union(matched.select("ext", F.lit("disambiguate").alias("stage")))
        by_language = {r.language: {k: v for k, v in r.asDict().items() if k != "language"} for r in ops.language_metrics(staged, ["discover", "probe", "disambiguate", "verify"]).collect()}
        counts = {k: v["n_verify"] for k, v in by_language.items() if v["n_verify"]}
        times["verify"] = int((time.monotonic() - began) * 1000)
        self._remember(spec, top)
        actions = [f"inspect {t['path']}:{t['line_no']}" for t in top]
        return Summary(spec.symbol, queries, top, actions, metrics, counts, sum(counts.values()), stage, times, warnings, sum(times.values()), self.startup_ms, any(t["auto"] for t in top), by_language)

    def _shown(self, spec: SearchSpec, best: DataFrame) -> DataFrame:
        """The best hits with their window of lines, body, snippet, hints and label.

        The hits are few and so are their files: from here on they are one partition, so nothing is shuffled, and hints are
        planned only for the languages that the hits have.
        """
        rows = best.collect()
        best = self.spark.createDataFrame(rows, best.schema).coalesce(1)
        shown = ops.with_context(best, self.files, spec.context_before, spec.context_after, want_body=spec.body)
        ext = {r.ext for r in rows if r.ext}
        hints, context, marks = F.lit(None).cast("array<struct<line: bigint, kind: string, label: string>>"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
        if ext & {"rs", "swift"}:
            wanted = best.where(F.col("ext").isin("rs", "swift")).groupBy("path").agg(F.collect_set("line_no").alias("at"))
            near = structure.with_lines(self.files.join(F.broadcast(wanted.select("path")), "path", "left_semi")).join(F.broadcast(wanted), "path")
            found = structure.context_hints(near, F.col("at"))
            shown, hints = shown.join(found, ["path", "line_no"], "left"), F.col("hints")
            if "swift" in ext:
                around = structure.swift_surroundings(near.where("ext = 'swift'")).select("path", "line_no", "context", "marks")
                shown, context, marks = shown.join(around, ["path", "line_no"], "left"), F.col("context"), F.col("marks")
        label = ops.origin_label(F.col("origin"), ops.language_of(F.col("ext")))
        made = {"hints": hints, "short": snippets.formatted(F.col("snippet"), F.col("ext"), context, marks, ext), "origin_label": label}
        return shown.withColumns(made).drop("context", "marks")

    def _remember(self, spec: SearchSpec, top: list[dict]) -> None:
        self.seen |= {(t["path"], t["line_no"]) for t in top}
        self.state.observe(spec.symbol, [t["path"] for t in top], time.time())
        if self.state_path:
            self.state.save(self.state_path)


def _needle(symbol: str) -> str:
    return symbol if not re.search(r"[^A-Za-z0-9_.]", symbol) else re.escape(symbol)


class _limit:
    """Cancels the jobs of a block after some seconds."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.context, self.group = spark.sparkContext, f"search-{time.monotonic_ns()}"
        self.timer = threading.Timer(max(seconds, 0.1), self.context.cancelJobGroup, [self.group])
        self.timer.daemon = True

    def __enter__(self):
        self.context.setJobGroup(self.group, "search stage", True)
        self.timer.start()

    def __exit__(self, *exc):
        self.timer.cancel()
        self.context.setLocalProperty("spark.jobGroup.id", None)


def search(spark: SparkSession, spec: SearchSpec) -> Summary:
    """One search over a tree of files; appends to the log folder if one is named."""
    set_up_logs(spec.telemetry)
    files = tree_files(spark, spec.root)
    engine = Engine(spark, files, tree_pages(files) if spec.use_pages else None, spec.state_path, spec.index_dir)
    began = time.monotonic()
    summary = engine.search(spec)
    if spec.log_dir:
        append_log(spec, summary, int((time.monotonic() - began) * 1000))
    return summary


class _Json(logging.Formatter):
    """One JSON object a line: time, level, message and whatever a call adds."""

    PLAIN = set(logging.makeLogRecord({}).__dict__)

    def format(self, record: logging.LogRecord) -> str:
        more = {k: v for k, v in record.__dict__.items() if k not in self.PLAIN}
        return json.dumps({"time": record.created, "level": record.levelname.lower(), "message": record.getMessage(), **more}, default=str)


def set_up_logs(telemetry: bool = True) -> None:
    """Structured logs to standard error, at the level that SIFTWELL_LOG names; none where telemetry is off."""
    log.handlers.clear()
    log.propagate = False
    handler = logging.StreamHandler() if telemetry else logging.NullHandler()
    handler.setFormatter(_Json())
    log.addHandler(handler)
    log.setLevel(os.environ.get("SIFTWELL_LOG", "warning").upper() if telemetry else logging.CRITICAL)


def append_log(spec: SearchSpec, summary: Summary, latency_ms: int) -> None:
    """One JSON line for a search."""
    os.makedirs(spec.log_dir, exist_ok=True)
    status = "ok" if summary.top_hits else "empty"
    record = {"timestamp": time.time(), "root": spec.root, "symbol": spec.symbol, "use_index": spec.use_index, "use_rga": spec.use_pages, "use_fd": spec.use_names, "use_ast_grep": spec.use_structure, "status": status, "latency_ms": latency_ms, "summary": json.loads(summary.to_json())}
    with open(os.path.join(spec.log_dir, "search.log.jsonl"), "a", encoding="utf-8") as f:
        f.write(json.dumps(record, separators=(",", ":")) + "\n")
