"""The walking data source against the tree scan, and what it lists."""

import os

import pytest

from siftwell.sources import walk
from siftwell.sources.corpus import tree_files

TREE = {
    "a.rs": "fn a() {}\n", "src/b.rs": "x", "src/deep/er/c.ts": "y", "src/deep/er/still/d.md": "", "build/out.rs": "no", "node/pkg/e.js": "no", ".hidden/f.rs": "no", "src/_under.rs": "only here",
    ".gitignore": "build/\n/node\n*.log\n", "src/.ignore": "*.tmp\n!kept.tmp\n", "src/x.tmp": "no", "src/kept.tmp": "yes", "run.log": "no", "src/deep/run.log": "no",
}


@pytest.fixture
def root(tmp_path):
    for name, body in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def test_walk_equals_scan(spark, root):
    columns = ["path", "dir", "name", "ext", "body", "n_bytes", "modified"]
    scanned = {r.path: r for r in tree_files(spark, root).select(columns).collect()}
    walked = {r.path: r for r in walk.walked_files(spark, root).select(columns).collect()}
    assert set(walked) == {"a.rs", "bad.rs", "src/b.rs", "src/deep/er/c.ts", "src/deep/er/still/d.md", "src/kept.tmp", "src/_under.rs"}
    # Spark's own sources pass over empty files and names with an underscore.
    assert set(walked) - set(scanned) == {"src/_under.rs", "src/deep/er/still/d.md"} and set(scanned) <= set(walked)
    for path, r in scanned.items():
        w = walked[path]
        assert (w.dir, w.name, w.ext, w.body, w.n_bytes) == (r.dir, r.name, r.ext, r.body, r.n_bytes)
        assert abs((w.modified - r.modified).total_seconds()) < 0.01
    assert {r.path for r in walk.walked_files(spark, root, 1).collect()} == {"src/b.rs", "src/deep/er/c.ts", "src/deep/er/still/d.md"}


def test_ignored_folders_are_never_listed(root, monkeypatch):
    listed, real = [], os.scandir
    monkeypatch.setattr(walk.os, "scandir", lambda p: listed.append(os.path.relpath(p, root)) or real(p))
    for levels in (0, 1, 2, 5):
        found = sorted(f"{d}/{e.name}".lstrip("/") for p in walk.parts(root, levels) for d, e in walk.walk(root, p.path, p.rules, p.whole))
        assert found == ["a.rs", "bad.rs", "src/_under.rs", "src/b.rs", "src/deep/er/c.ts", "src/deep/er/still/d.md", "src/kept.tmp"], levels
    assert {x for x in listed if x.startswith(("build", "node", ".hidden"))} == set()


def test_parts_are_folders(root):
    assert [(p.path, p.whole) for p in walk.parts(root, 2)] == [("", False), ("src", False), ("src/deep", True)]
    assert [(p.path, p.whole) for p in walk.parts(root, 0)] == [("", True)]


def test_many_rules_stay_a_loop(root):
    """Thousands of rules are tested one after the other, not built into one expression."""
    with open(os.path.join(root, ".gitignore"), "a") as f:
        f.write("".join(f"name_{i}.x\n" for i in range(5000)))
    rules = walk.rules_in(root, "", ())
    assert len(rules) == 5003 and walk.is_ignored("a/name_4999.x", rules) and not walk.is_ignored("a/name_5000.x", rules)
