"""Scopes, signatures and rules over several lines of small sources, and range joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import ranges, scopes, structure
from siftwell.sources.corpus import lines_of

SOURCES = {
    "a.rs": """mod bank {
    // a brace in a comment {
    impl<'a, T: Into<u8>>
        fmt::Display for Ledger<'a, T>
    where
        T: Copy,
    {
        pub fn post_entry(
            &mut self,
            cents: i64,
        ) -> Result<(), Error> {
            let s = "a { in a text";
            let c = '{';
            for x in [1, 2] {
                self.go(|y| { y });
            }
        }
    }
    struct Unit;
    pub enum Kind { A, B }
}
""",
    "b.ts": """export const load = async (
  id: number,
): Promise<void> => {
  if (id) {
    return;
  }
};
class Box<T> {
  private open(
    key: string,
    f: (x: number) => void
  ): void {
    const t = `a { ${key}
    }`;
  }
}
export {
  load,
  Box as Crate,
};
interface Shape { size: number }
""",
    "c.swift": """extension Feed: Codable {
    @MainActor
    public func refreshAll(
        page: Int
    ) async throws -> [Item] {
        guard page > 0 else { return [] }
    }
    init(
        name: String
    ) {
        self.name = name
""",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, p.rpartition(".")[2], b) for p, b in SOURCES.items()] + [("empty.rs", "rs", ""), ("none.rs", "rs", None), ("odd.rs", "rs", "} } {\n) (\n}"), ("x.md", "md", "{ }")]
    return spark.createDataFrame(rows, "path string, ext string, body string")


def test_scopes_of_sources(files):
    found = {(r.path, r.kind, r.name): r for r in scopes.scopes(files).where("kind <> 'block'").collect()}
    lines = {k: (r.first_line, r.open_line, r.end_line) for k, r in found.items()}
    assert lines == {
        ("a.rs", "mod", "bank"): (1, 1, 21), ("a.rs", "impl", "Ledger"): (3, 7, 18), ("a.rs", "fn", "post_entry"): (8, 11, 17), ("a.rs", "enum", "Kind"): (20, 20, 20),
        ("b.ts", "arrow", "load"): (1, 3, 7), ("b.ts", "class", "Box"): (8, 8, 16), ("b.ts", "method", "open"): (9, 12, 15), ("b.ts", "interface", "Shape"): (21, 21, 21),
        ("c.swift", "extension", "Feed"): (1, 1, None), ("c.swift", "func", "refreshAll"): (2, 5, 7), ("c.swift", "init", "init"): (8, 10, None),
    }
    assert found["a.rs", "fn", "post_entry"].signature == "pub fn post_entry ( & mut self , cents : i64 , ) - > Result < ( ) , Error >"
    blocks = scopes.scopes(files).where("kind = 'block'").groupBy("path").count().collect()
    assert dict(map(tuple, blocks)) == {"a.rs": 2, "b.ts": 2, "c.swift": 1, "odd.rs": 1}


def test_innermost_scope(spark, files):
    hits = spark.createDataFrame([("a.rs", 9), ("a.rs", 14), ("a.rs", 19), ("a.rs", 3), ("b.ts", 5), ("b.ts", 13), ("b.ts", 18), ("c.swift", 11), ("x.md", 1), ("gone.rs", 1)], "path string, line_no long")
    found = {(r.path, r.line_no): (r.scope_kind, r.scope_name, r.scope_start, r.scope_end) for r in scopes.innermost(hits, scopes.scopes(files)).collect()}
    none = (None,) * 4
    assert found == {
        ("a.rs", 9): ("fn", "post_entry", 8, 17), ("a.rs", 14): ("fn", "post_entry", 8, 17), ("a.rs", 19): ("mod", "bank", 1, 21), ("a.rs", 3): ("impl", "Ledger", 3, 18), ("b.ts", 5): ("arrow", "load", 1, 7),
        ("b.ts", 13): ("method", "open", 9, 15), ("b.ts", 18): none, ("c.swift", 11): ("init", "init", 8, None), ("x.md", 1): none, ("gone.rs", 1): none,
    }


def test_rules_match_over_lines(files):
    lines = lines_of(files)

    def new(symbol, language):
        found = scopes.all_matches(files, lines, symbol, [language]).select("rule", "path", "line_no")
        return {tuple(r) for r in found.subtract(structure.rule_matches(lines, symbol, [language]).select("rule", "path", "line_no")).collect()}

    assert new("load", "ts") == {("arrow_variable", "b.ts", 1), ("export_specifier", "b.ts", 18)}
    assert new("open", "ts") == {("method", "b.ts", 9)}
    assert new("refreshAll", "swift") == set() and new("String", "swift") == {("initializer", "c.swift", 9)}
    assert new("Unit", "rust") == set() and not scopes.broken_matches(files, "absent", ["rust"]).collect()


def test_points_in_ranges_equal_loops(spark):
    rng = random.Random(6)
    points = [(f"f{rng.randrange(3)}", rng.randrange(1, 400)) for _ in range(150)]
    spans = [(f"f{rng.randrange(4)}", a, a + rng.randrange(0, 300)) for a in (rng.randrange(1, 400) for _ in range(60))]
    met = ranges.containing(spark.createDataFrame(points, "path string, line_no long"), spark.createDataFrame(spans, "path string, start long, end long"), width=16)
    assert sorted(map(tuple, met.select("path", "line_no", "start", "end").collect())) == sorted((p, n, a, b) for p, n in points for q, a, b in spans if p == q and a <= n <= b)
    wanted = []
    for f in sorted({p for p, _ in points}):
        for n in sorted(n for p, n in points if p == f):
            if wanted and wanted[-1][0] == f and wanted[-1][2] + 1 >= n - 3:
                wanted[-1][2], wanted[-1][3] = max(wanted[-1][2], n + 3), wanted[-1][3] + 1
            else:
                wanted.append([f, max(1, n - 3), n + 3, 1])
    found = ranges.merged(spark.createDataFrame(points, "path string, line_no long"), 3, 3).select("path", "start", "end", "hits")
    assert sorted(map(list, found.collect())) == wanted


def test_budget_takes_lines_in_rule_order(files):
    """The first so many lines by language, rule and place, each with all its rules."""
    every = structure.rule_matches(lines_of(files), "load", ["ts"]).collect()
    some = structure.rule_matches(lines_of(files), "load", ["ts"], 1).collect()
    assert {r.line_no for r in every} == {1, 18} and {r.line_no for r in some} == {1} and len(some) == sum(r.line_no == 1 for r in every)
    assert not structure.rule_matches(lines_of(files).where(F.col("path") == "x.md"), "load", ["ts"], 1).collect()
