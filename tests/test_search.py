"""The search API over a small tree of files, state, requests, streams, and expressions against plain Python."""

import json
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import rewrite, snippets
from siftwell.operators import observe, search as ops, structure
from siftwell.operators.state import State
from siftwell.plans.search import Engine, SearchSpec, search
from siftwell.sources.corpus import ignore_rule, lines_of, tree_files
from siftwell.streaming.telemetry import log_stream, windowed_counts

TREE = {
    "src/ledger.rs": "mod bank {\n// moves money\n#[derive(Debug)]\npub struct Account;\n\nimpl Account {\n    #[inline]\n    // checked\n    pub fn post_entry(&mut self, cents: i64) -> bool {\n        cents > 0\n    }\n}\n}\n",
    "src/use.rs": "fn run(a: &mut Account) {\n    a.post_entry(3);\n}\n",
    "web/chart.tsx": "export const BarChart: React.FC<{ rows: number[] }> = ({ rows }) => (\n  <BarChart rows={rows} />\n);\nexport async function loadRows(id: number): Promise<string> {\r\n  return 'x';\r\n}",
    "Package.swift": "// manifest\n",
    "Sources/Feed/Store.swift": "protocol Feed {\n  func refresh(page: Int) async\n}\n\nextension Feed {\n  @MainActor\n  @discardableResult\n  public func refreshAll(page: Int) async {\n    await refresh(page: page)\n  }\n}\n",
    "config/limits.yaml": "post_entry_limit: 3\n",
    ".hidden/secret.rs": "fn post_entry() {}\n",
    "docs/loadRows_notes.md": "nothing here\n" + "long " * 60 + "marker_7\n",
    "build/out.rs": "fn post_entry() {}\n",
    "src/gen/kept.rs": "fn kept_thing() {}\n",
    "src/gen/made.rs": "fn post_entry() {}\n",
    ".gitignore": "# made\nbuild/\n*.log\n",
    "src/gen/.gitignore": "*.rs\n!kept.rs\n",
    "run.log": "post_entry\n",
    "web/price.ts": "const $price = 3\nlet x$price = $price + 1\nprint($price)\n",
    "docs/help.html": "<p>Help</p>\n<p>only in a page</p>\n",
    "empty.rs": "",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(body.encode())
    (base / "bad.rs").write_bytes(b"fn post_entry \xff\xfe")
    return str(base)


def test_literal_search(spark, root, tmp_path):
    s = search(spark, SearchSpec("post_entry", root=root, language="rust", log_dir=str(tmp_path)))
    assert [(t["path"], t["line_no"]) for t in s.top_hits] == [("config/limits.yaml", 1), ("src/ledger.rs", 9), ("src/use.rs", 2)]
    assert s.stage == "rg-global" and all(t["score"] == pytest.approx(0.95) for t in s.top_hits)
    assert s.metrics == {"precision": 0.0, "density": 0.5, "clustering": 0.33, "reward": 0.2}
    assert s.top_hits[1]["body"].startswith("mod bank") and s.top_hits[0]["body"] is None and s.auto_expanded_context
    assert s.top_hits[2]["expanded_snippet"] == "1 fn run(a: &mut Account) {\n2     a.post_entry(3);\n3 }\n"
    assert s.queries[4:6] == ["fn post_entry", "impl post_entry"] and s.queries[3] == "Entry\\.post_entry"
    assert [(h["line"], h["kind"]) for h in s.top_hits[1]["hints"]] == [(1, "module"), (6, "impl"), (7, "attribute"), (9, "declaration")]
    assert [(h["line"], h["kind"], h["label"]) for h in s.top_hits[2]["hints"]] == [(1, "declaration", "fn run(a: &mut Account) {")]
    assert not s.top_hits[0]["hints"] and s.cycle_ms == sum(s.stage_ms.values()) and s.language_metrics["rust"]["n_verify"] == 2
    record = json.loads((tmp_path / "search.log.jsonl").read_text())
    assert record["symbol"] == "post_entry" and record["status"] == "ok" and record["summary"]["top_hits"][1]["hints"]


def test_swift_hits_have_hints_and_their_snippet(spark, root):
    s = search(spark, SearchSpec("refreshAll(", root=root, language="swift", context_before=1, context_after=1))
    hit = s.top_hits[0]
    assert s.stage == "rg-scoped" and (hit["path"], hit["line_no"], hit["context_start"], hit["context_end"]) == ("Sources/Feed/Store.swift", 8, 7, 9)
    assert hit["short"] == "extension Feed { :: public func refreshAll(page: Int) async { [async] [public] [@MainActor] [@discardableResult]"
    assert [(h["line"], h["kind"]) for h in hit["hints"]] == [(5, "extension"), (6, "attribute"), (7, "attribute"), (8, "declaration")]
    assert hit["body"] and not hit["auto"]


def test_candidates_come_from_all_sources_in_order(spark, root):
    engine = Engine(spark, tree_files(spark, root))
    engine.state.symbol_hits["Store"] = ["src/use.rs", "gone.rs", "Package.swift"]
    engine.state.directory_scores = {"Sources/Feed": 3, "src": 2}
    found = engine.candidates(SearchSpec("Store", language="auto-swift-rs")).orderBy("src_rank", "pos").collect()
    assert [(r.path, r.src_rank) for r in found] == [("Sources/Feed/Store.swift", 0), ("src/use.rs", 1), ("Package.swift", 1), ("src/ledger.rs", 2)]


def test_dollar_symbols_get_structure(spark, root):
    s = search(spark, SearchSpec("$price", root=root, language="ts"))
    assert {(t["line_no"], t["origin"]) for t in s.top_hits} == {(1, "ast-grep"), (2, "ast-grep"), (3, "ast-grep")} and s.metrics["precision"] == 1.0
    lines = lines_of(tree_files(spark, root))
    found = structure.rule_matches(lines, "$price", ["ts"]).groupBy("line_no").agg(F.sort_array(F.collect_set("rule")).alias("r")).collect()
    assert {r.line_no: r.r for r in found} == {1: ["identifier", "variable"], 2: ["identifier"], 3: ["identifier"]}
    assert structure.rule_matches(lines, "kept_thing", ["python"]).count() == 0
    assert structure.rule_matches(lines, "post_entry_limit", ["python"]).count() == 1
    assert not structure.rule_matches(lines, "$price", []).collect()
    assert structure.rule_matches(lines, "$price", ["ts"], 2).select("line_no").distinct().count() == 2


def test_stages_after_an_empty_one(spark, root, tmp_path):
    files = tree_files(spark, root)
    engine = Engine(spark, files, index_dir=str(tmp_path / "ix"))
    found = engine.search(SearchSpec("Feed {", language="swift"))
    assert found.stage == "rg-scoped" and {t["path"] for t in found.top_hits} == {"Sources/Feed/Store.swift"}
    assert engine.search(SearchSpec("Feed {", language="swift")).top_hits == []  # seen before
    none = engine.search(SearchSpec("absent_thing", use_index=True))
    assert none.stage == "" and none.metrics["reward"] == 0 and not none.top_hits
    built = sorted(p.name for p in (tmp_path / "ix" / "versions").glob("*.json"))
    assert built == ["00000001.json"]
    indexed = engine.search(SearchSpec("Nothing here", use_index=True))
    assert indexed.stage == "rg-indexed" and [t["path"] for t in indexed.top_hits] == ["docs/loadRows_notes.md"] and indexed.top_hits[0]["score"] == pytest.approx(1.1)
    assert sorted(p.name for p in (tmp_path / "ix" / "versions").glob("*.json")) == built  # opened, not built again
    pages = spark.createDataFrame([("http://x", 3, "an absent_thing in a page")], "url string, line_no long, line string")
    rich = Engine(spark, files, pages).search(SearchSpec("absent_thing", use_pages=True))
    assert rich.stage == "rga" and rich.top_hits[0]["path"] == "http://x" and rich.top_hits[0]["score"] == pytest.approx(0.8)
    odd = Engine(spark, files, pages).search(SearchSpec("absent(", use_pages=True))
    assert odd.stage == "" and odd.warnings[-1].startswith("rga: ")  # no pattern: a warning


def test_request_names(tmp_path):
    own = SearchSpec("-", index_dir=str(tmp_path), root="/r")
    spec = SearchSpec.from_request({"symbol": "x", "use_fd": False, "use_ast_grep": False, "enable_index": True, "tool_flags": {"RGA": True, "include_body": True}, "index_dir": "sub", "root": "a"}, own)
    assert (spec.use_names, spec.use_structure, spec.use_index, spec.use_pages, spec.body) == (False, False, True, True, True)
    assert spec.index_dir == os.path.realpath(tmp_path / "sub") and spec.root == "/r/a"
    assert SearchSpec.from_request({"symbol": "x", "disable_fd": True, "tool_flags": {"fd": True, "nothing": True}}, own).use_names is False
    for bad in ({"index_dir": "../out"}, {"log_dir": "/tmp"}, {"cache_dir": "/tmp/x"}):
        with pytest.raises(ValueError, match="below"):
            SearchSpec.from_request({"symbol": "x", **bad}, own)


def test_logs_are_json_lines_with_fields(capsys):
    import logging

    from siftwell.plans.search import log, set_up_logs

    set_up_logs()
    log.setLevel(logging.INFO)
    log.info("stage", extra={"stage": "rg-global", "ms": 3})
    record = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert record["message"] == "stage" and record["level"] == "info" and record["stage"] == "rg-global" and record["ms"] == 3 and record["time"] > 0
    set_up_logs(telemetry=False)
    log.critical("unseen")
    log.error("unseen")
    assert "unseen" not in capsys.readouterr().err


def test_startup_is_rounded_up_and_stages_down(spark, root, monkeypatch):
    from siftwell.plans import search as plan

    clock = iter(x / 1000 for x in (0.0, 0.2, *(10 * i + 0.9 * i for i in range(400))))
    monkeypatch.setattr(plan.time, "monotonic", lambda: next(clock))
    engine = Engine(spark, tree_files(spark, root))
    assert engine.startup_ms == 1
    s = engine.search(SearchSpec("kept_thing"))
    assert all(isinstance(v, int) and v >= 10 for v in s.stage_ms.values()) and s.cycle_ms == sum(s.stage_ms.values())


def test_slow_stages_are_cancelled(spark):
    from siftwell.plans.search import _limit

    slow = spark.range(0, 1 << 40, 1, 4).where("sha2(cast(id as string), 256) = 'x'")
    with pytest.raises(Exception, match="(?i)cancel"), _limit(spark, 0.5):
        slow.isEmpty()


def test_ignore_files(spark, root):
    paths = {r.path for r in tree_files(spark, root).select("path").collect()}
    assert paths == {p for p in TREE if not p.startswith((".", "build")) and p not in ("src/gen/made.rs", "src/gen/.gitignore", "run.log", "empty.rs")} | {"bad.rs"}
    for rule, yes, no in (("/a/*.x", ["a/b.x"], ["c/a/b.x", "a/b/c.x"]), ("**/tmp/", ["tmp/a", "a/tmp/b"], ["tmp"]), ("doc/**", ["doc/a/b"], ["doc", "x/doc/a"]), ("f?o[!0-9]", ["fxoa", "z/fxob/c"], ["fxo1", "foa"])):
        pattern, ignores = ignore_rule(rule, "")
        assert ignores and all(re.match(pattern, p) for p in yes) and not any(re.match(pattern, p) for p in no), rule
    assert ignore_rule("# x", "") is None and ignore_rule("!a", "d") == ("^d/(?:.*/)?a(?:/.*)?$", False)


def test_snippets_of_several_lines(spark):
    ts = {"// c\ntype A = 1\nconst f = () => use(1)\n": "const f = () => use(1) [arrow]", "x\n<Tag a>\ny": "<Tag a>", "// only": "// only", "a\nexport const b: Promise<X> = async () => 1": "export const b: Promise<X> = async () => 1 [async] [promise] [arrow] [generic]", " \n": None}
    swift = {
        "@A\nstruct S<T> {\n@B\n  private func f(\n": "struct S<T> { [generic] [@A] [@B]", "extension E {\n @C\n func g()\n   async throws\n   -> Int {\n x": "extension E { [@C]", "@D\n func h()\n async\n\n where T": "func h() async [async] [@D]", "let x = await y": "let x = await y [await]", "\n": None,
    }
    for cases, f in ((ts, snippets.typescript), (swift, lambda x: snippets.swift(x, F.lit(None).cast("string"), F.lit(None).cast("array<string>")))):
        rows = spark.createDataFrame([(t,) for t in cases], "t string")
        assert {r.t: r.v for r in rows.select("t", f(F.col("t")).alias("v")).collect()} == cases


def test_command_line(spark, root, tmp_path, capsys):
    from siftwell.__main__ import main

    assert main(["--disable-telemetry", "search", "refresh", "--path", root, "--language", "swift"]) == 0
    assert [t["path"] for t in json.loads(capsys.readouterr().out)["top_hits"]] == ["Sources/Feed/Store.swift"] * 3
    assert main(["search", " "]) == 2
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "symbol": "kept_thing", "expected": {"path": "kept.rs"}}]))
    assert main(["bench", "--scenarios", str(tmp_path / "s.json"), "--path", root, "--iterations", "1", "--output", str(tmp_path)]) == 0
    assert json.loads((tmp_path / "benchmark-summary.jsonl").read_text())["totals"]["success_rate"] == 1.0


def test_service(spark, root):
    from threading import Thread
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from siftwell.plans.serve import Service

    def ask(path, body=None):
        with urlopen(Request(url + path, None if body is None else json.dumps(body).encode())) as r:
            return r.read().decode()

    with Service(spark, {"root": root, "max_matches": 5}) as service:
        Thread(target=service.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{service.server_address[1]}"
        assert json.loads(ask("/healthz")) == {"status": "ok"} and ask("/metrics") == ""
        found = json.loads(ask("/search", {"symbol": "kept_thing", "root": "src", "language": "", "context_before": 0}))["summary"]
        assert [(t["path"], t["line_no"]) for t in found["top_hits"]] == [("gen/kept.rs", 1)]
        assert 'stages_total{label="rg-global"} 1' in ask("/metrics")
        page = json.loads(ask("/search", {"symbol": "only in a page", "use_rga": True, "tool_flags": {"fd": False}}))["summary"]
        assert [(t["path"], t["line_no"], t["origin"]) for t in page["top_hits"]] == [("docs/help.html", 2, "rg-scoped")]
        for path, body, status in (("/search", {"symbol": " "}, 400), ("/search", {"symbol": "x", "index_dir": "/tmp/elsewhere"}, 400), ("/search", [1], 400), ("/nothing", None, 404)):
            with pytest.raises(HTTPError) as e:
                ask(path, body)
            assert e.value.code == status
        service.shutdown()


def test_p95_by_the_exclusive_rule(spark):
    import statistics

    rng = random.Random(3)
    sizes = {"one": 1, "few": 19, "some": 20, "ties": 3000, "many": 120_000, None: 40}
    data = {k: [float(rng.randrange(7)) if k == "ties" else rng.expovariate(0.1) for _ in range(n)] for k, n in sizes.items()}
    runs = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "name string, ms double")
    for r in observe.latency_summary(runs).collect():
        v = data[r.name]
        assert r.n == len(v) and r.p95_ms == pytest.approx(max(v) if len(v) < 20 else statistics.quantiles(v, n=20)[18], abs=1e-6), r.name


def test_long_line_widens_context(spark, root):
    hit = search(spark, SearchSpec("marker_7", root=root, context_before=1, context_after=1)).top_hits[0]
    assert hit["truncated"] and hit["snippet_length"] == 309 and (hit["context_start"], hit["context_end"], hit["auto"]) == (1, 2, True)


def test_specs_and_requests():
    with pytest.raises(ValueError):
        SearchSpec("  ")
    with pytest.raises(ValueError):
        SearchSpec("é" * 129)
    assert SearchSpec("x", language="auto-swift-ts").languages == ["swift", "ts", "tsx"]
    assert SearchSpec("a_1").literal and not SearchSpec("a.b").literal
    base = SearchSpec("x", max_matches=7)
    got = SearchSpec.from_request({"symbol": " y ", "tools": {"index": True, "disable_fd": True, "odd": True}}, base)
    assert (got.symbol, got.max_matches, got.use_index, got.use_names) == ("y", 7, True, False)


def test_state_is_replaced_whole_and_bounded(tmp_path):
    path = str(tmp_path / "deep" / "state.json")
    s = State()
    for i in range(600):
        s.observe(f"s{i}", [f"d{i}/f{j}" for j in range(30)], float(i))
    s.save(path)
    again = State.load(path)
    assert len(again.symbol_hits) == 500 and "s599" in again.symbol_hits and "s0" not in again.symbol_hits
    assert len(again.directory_scores) == 200 and len(again.symbol_hits["s599"]) == 10
    (tmp_path / "bad.json").write_text("{")
    assert State.load(str(tmp_path / "bad.json")).warnings and not State.load(str(tmp_path / "none.json")).warnings


def test_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, stage string, ms double"
    rows = [{"ts": f"2024-01-01T00:{m:02d}:00Z", "stage": s, "ms": float(m)} for m in range(30) for s in ("probe", "verify")] + [{"ts": "2024-01-01T03:00:00Z", "stage": "end", "ms": 0.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    q = windowed_counts(log_stream(spark, str(tmp_path / "in"), schema), "stage", "ms").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {tuple(r) for r in spark.table("windows").collect()}
    batch = windowed_counts(spark.read.schema(schema).json(str(tmp_path / "in")), "stage", "ms")
    assert streamed == {tuple(r) for r in batch.where("label <> 'end'").collect()} and len(streamed) == 12


def loop_attributes(lines, mark):
    out = []
    for i, x in enumerate(lines):
        t = x.strip(" ")
        if t.startswith(mark) or t == "" or t.startswith("//"):
            continue
        for j in range(i - 1, -1, -1):
            u = lines[j].strip(" ")
            if u.startswith(mark):
                out.append((i + 1, j + 1))
            elif u and not u.startswith("//"):
                break
    return sorted(out)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["#[a]", "", "// c", "fn f() {", "mod m {", "  mod n {", "}", "struct S {"]), min_size=1, max_size=25))
def test_windows_equal_loops(spark, lines):
    df = spark.createDataFrame([("f", "rs", lines)], "path string, ext string, lines array<string>")
    assert sorted((r.line_no, r.attribute_line) for r in structure.attributes(df, "#[").collect()) == loop_attributes(lines, "#[")
    mods = [i + 1 for i, x in enumerate(lines) if x.startswith("mod ")]
    want = sorted((i + 1, m) for i in range(len(lines)) for m in [m for m in mods if m <= i + 1][-3:])
    assert sorted((r.line_no, r.module_line) for r in structure.last_modules(df, lambda x: F.lit(True)).collect()) == want
    declared = [i + 1 for i, x in enumerate(lines) if x.startswith(("fn ", "struct "))]
    above = {r.line_no: r.d_line for r in structure.nearest_above(df, structure.is_rust_declaration, "d", True).collect()}
    assert above == {i + 1: max((d for d in declared if d <= i), default=None) for i in range(len(lines))}


def test_structure_stays_in_the_row(spark):
    """No exchange in the plans, and a file of many lines takes time that follows them."""
    import time

    body = "mod m {\n#[a]\nfn f() {\n// c\n\n}\nimpl X {\nlet y = 1;\n" * 5000
    rows = structure.with_lines(spark.createDataFrame([("f.rs", "rs", body), ("null.rs", "rs", None), ("empty.rs", "rs", "")], "path string, ext string, body string"))
    every = F.transform("lines", lambda x, i: i + 1)
    began = time.monotonic()
    for df in (structure.nearest_above(rows, structure.is_rust_declaration, "d"), structure.attributes(rows, "#["), structure.last_modules(rows, structure.is_rust_declaration), structure.context_hints(rows, every), structure.swift_surroundings(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0
    assert time.monotonic() - began < 60
    hints = structure.context_hints(rows, F.array(F.lit(39_992), F.lit(3))).orderBy("line_no").collect()
    last = [(39969, "module"), (39977, "module"), (39983, "impl"), (39985, "module"), (39986, "attribute"), (39987, "declaration")]
    assert [[(h.line, h.kind) for h in r.hints] for r in hints] == [[(1, "module"), (2, "attribute"), (3, "declaration")], last]


def test_hits_equal_union_of_rewrites(spark, root):
    lines = lines_of(tree_files(spark, root))
    for symbol, language in (("post_entry", "rust"), ("loadRows", "ts"), ("refresh", "swift")):
        queries = [r.query for r in rewrite.rewritten(spark.createDataFrame([(symbol,)], "symbol string"), language).collect()]
        union = lines.where(" OR ".join(f"line RLIKE r'{q}'" for q in queries))
        assert union.count() == lines.where(F.contains("line", F.lit(symbol))).count() > 0


def test_shares_add_up(spark):
    keys = spark.createDataFrame([(k,) for k in "cab"], "k string")
    assert {r.k: r.share_ms for r in ops.distribute(F.lit(10), keys, "k").collect()} == {"a": 4, "b": 3, "c": 3}


def test_expectations(spark):
    hits = spark.createDataFrame([("a", "x/y.rs", 3, 1), ("a", "z.rs", 4, 2), ("b", "q.rs", 1, 1)], "name string, path string, line_no long, rank long")
    expected = spark.createDataFrame([("a", "y.rs", 3, None), ("b", "rs", None, None), ("c", None, None, None)], "name string, path string, line_no long, top_n long")
    assert {r.name: r.ok for r in observe.expectation_met(hits, expected).collect()} == {"a": True, "b": False, "c": False}


def test_scenarios(spark, root, tmp_path):
    from siftwell.plans import scenarios

    (tmp_path / "s.json").write_text(json.dumps([{"name": "rust", "symbol": "post_entry", "language": "rust", "expected": {"path": "ledger.rs", "line": 9, "top_n": 3}}, {"name": "miss", "symbol": "absent_thing"}]))
    runs = scenarios.run_scenarios(spark, scenarios.read_scenarios(spark, str(tmp_path / "s.json")), root, iterations=2)
    report = observe.scenario_report(runs).cache()
    assert {r.name: (r.iterations, r.success_rate) for r in report.collect()} == {"rust": (2, 1.0), "miss": (2, 0.0), None: (4, 0.5)}
    scenarios.append_report(report, str(tmp_path))
    record = json.loads((tmp_path / "benchmark-summary.jsonl").read_text())
    assert record["totals"]["iterations"] == 4 and len(record["scenarios"]) == 2
