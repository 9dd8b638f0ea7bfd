"""The index's query syntax against a plain evaluation, and an index in a folder that follows its files."""

import math
import random
import re

import pytest

from siftwell.operators import index
from siftwell.operators.query_syntax import QueryError, parse
from siftwell.plans.search import Engine, SearchSpec
from siftwell.sources.corpus import tree_files

WORDS = "alpha beta gamma delta alpine bet".split()


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(2)
    out = {f"d{i}.rs": " ".join(rng.choices(WORDS, k=rng.randrange(1, 12))) for i in range(60)}
    return out | {"empty.rs": "", "odd.rs": "Alpha_BETA,gamma! " + "x" * 50 + " beta É1 é1"}


@pytest.fixture(scope="module")
def files(spark, bodies):
    return spark.createDataFrame([(p, b, len(b)) for p, b in bodies.items()], "path string, body string, n_bytes long").repartition(3)


def places(body):
    """(place, token) of a body; long tokens keep their place and are left out."""
    return [(i, t) for i, t in enumerate(re.findall(r"[^\W_]+", body.lower())) if len(t.encode()) < 40]


def scores(bodies, node):
    """path and score by walking the tree for each file, phrases by looking at each place."""
    held = {p: places(b) for p, b in bodies.items()}
    n, mean = len(held), sum(map(len, held.values())) / len(held)

    def idf(w):
        df = sum(any(t == w for _, t in x) for x in held.values())
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(node, at):
        if node.kind == "all":
            return node.weight
        if node.kind == "range":
            (low, high), found = node.bounds, [t for _, t in at]
            good = [t for t in found if (not low or t > low[0] or low[1] and t == low[0]) and (not high or t < high[0] or high[1] and t == high[0])]
            return node.weight if good else None
        if node.kind == "words":
            first = node.words[0][0] if node.words else 0
            tf = sum(all((i + p - first, w) in at for p, w in node.words) for i, t in at if node.words and t == node.words[0][1])
            if not tf:
                return None
            return node.weight * sum(idf(w) for _, w in node.words) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(at) / mean))
        parts = [(s, score(p, at)) for s, p in node.parts]
        must, should = [x for s, x in parts if s == "must"], [x for s, x in parts if s == "should"]
        if None in must or any(x is not None for s, x in parts if s == "not") or not must and all(x is None for x in should):
            return None
        return node.weight * sum(x for x in must + should if x is not None)

    found = {p: score(node, at) for p, at in held.items()}
    return {p: pytest.approx(x, abs=2e-6) for p, x in found.items() if x is not None}


QUERIES = [
    "alpha", "alpha beta", "ALPHA And beta", "alpha AND beta", "alpha AND beta OR gamma AND delta", "(alpha OR beta) AND gamma", "+alpha beta -gamma", "alpha AND NOT beta", '"alpha beta"', '"beta gamma delta" alpha^3',
    "alpha_beta", "alpha-beta", '-"alpha beta" +alpha', "body:alpha", "body:(alpha OR bet)^0.5 delta", "[alp TO bet]", "{alpha TO bet}", "[* TO alpha}", "[delta TO *]", "* -alpha", "*^2 AND beta", "é1", "nothing_here", "((((alpha))))",
    '"alpha xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx beta"', "alpha alpha", "alpha +(beta -gamma)", "alpha OR (beta AND (gamma OR delta) AND NOT alpine)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_query_equals_walking_the_tree(files, bodies, query):
    node = parse(query, index.tokenise)
    found = {r.path: r.bm25 for r in index.bm25(files, query).collect()}
    assert found == scores(bodies, node)


def test_random_queries(files, bodies):
    rng = random.Random(5)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([rng.choice(WORDS), '"' + " ".join(rng.choices(WORDS, k=2)) + '"', rng.choice(WORDS) + "^2"])
        parts = [made(depth - 1) for _ in range(rng.randrange(2, 4))]
        return "(" + rng.choice([" ", " AND ", " OR ", " AND NOT ", " +", " -"]).join(parts) + ")"

    for _ in range(12):
        query = made(3)
        try:
            node = parse(query, index.tokenise)
        except QueryError:
            continue
        assert {r.path: r.bm25 for r in index.bm25(files, query).collect()} == scores(bodies, node), query


def test_senseless_queries(files):
    for query in ("foo(", ")", "a AND", "OR a", "a OR", '"open', "-a", "NOT a", "nofield:a", "a^x", "[a b]", "[a TO", "()", "a::b", "(" * 60 + "a" + ")" * 60, "-a -b", "a AND (-b)"):
        with pytest.raises(QueryError):
            parse(query, index.tokenise)
    assert parse("  ", index.tokenise) is None and not index.bm25(files, " ").collect()
    assert not index.bm25(files, "...").collect()


def test_an_index_follows_its_files(spark, tmp_path, monkeypatch):
    tree, folder = tmp_path / "tree", str(tmp_path / "ix")
    tree.mkdir()
    write = lambda name, text: (tree / name).write_text(text)
    write("a.rs", "fn login user")
    write("b.swift", "func fetch user")
    write("c.md", "old words")
    tokenised, real = [], index.positional_postings

    def counting(files):
        tokenised.append(sorted(r.path for r in files.select("path").collect()))
        return real(files)

    monkeypatch.setattr(index, "positional_postings", counting)

    def opened():
        kept = index.Index(spark, folder)
        return kept, kept.refresh(tree_files(spark, str(tree)))

    kept, counts = opened()
    assert counts == {"added": 3, "changed": 0, "removed": 0} and kept.version.number == 1
    assert {r.path for r in kept.matches("user").collect()} == {"a.rs", "b.swift"}
    kept, counts = opened()
    assert not any(counts.values()) and kept.version.number == 1 and len(tokenised) == 1
    write("c.md", "new words of a user")
    write("d.ts", "user")
    (tree / "a.rs").unlink()
    kept, counts = opened()
    assert counts == {"added": 1, "changed": 1, "removed": 1} and tokenised[-1] == ["c.md", "d.ts"]
    for query in ("user", "old", "login", "new AND words"):
        now = index.bm25(tree_files(spark, str(tree)), query)
        assert sorted(map(tuple, kept.matches(query).collect())) == sorted(map(tuple, now.collect())), query
    live = {(r.token, r.path, tuple(r.positions)) for r in kept.postings().collect()}
    kept.merge()
    kept.vacuum()
    assert len(kept.version.segments) == 1 and live == {(r.token, r.path, tuple(r.positions)) for r in index.Index(spark, folder).postings().collect()}
    write("a.rs", "fn login user again")
    kept, counts = opened()
    assert counts["added"] == 1 and {r.path for r in kept.matches("login").collect()} == {"a.rs"}
    again = index.Index(spark, folder)
    again.version.number -= 1
    with pytest.raises(OSError):
        again._commit(index.Version(again.version.number + 1))


def test_many_refreshes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 2)
    for i in range(4):
        files = spark.createDataFrame([(f"{j}.rs", f"word{j} round{i if j < 2 else 0}") for j in range(i + 2)], "path string, body string")
        kept = index.Index(spark, str(tmp_path / "ix"))
        kept.refresh(files)
        assert len(kept.version.segments) <= 2
        assert {(r.token, r.path) for r in kept.postings().collect()} == {(r.token, r.path) for r in index.postings(files).collect()}


def test_searches_in_two_languages_share_an_index(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.rs").write_text("let login = user_id;\n")
    (tree / "b.swift").write_text("let Login = userId\nlet user = id\n")
    engine = Engine(spark, tree_files(spark, str(tree)), index_dir=str(tmp_path / "ix"))
    for language, path, word in (("rust", "a.rs", "Login USER_ID"), ("swift", "b.swift", "User  = ID")):
        s = engine.search(SearchSpec(word, language=language, use_index=True))
        found = engine._indexed(SearchSpec(word, language=language, use_index=True))
        assert [r.path for r in found.collect()] == [path] and not s.warnings
    odd = engine.search(SearchSpec("login(", use_index=True))
    assert odd.stage == "" and odd.warnings[-1].startswith("rg-indexed: ")


def test_only_the_hits_bodies_move(spark, files):
    """Before any exchange of bodies the files are cut to the hits' own."""
    from siftwell.operators import search as ops
    from pyspark.sql import functions as F

    many = files.withColumns({"ext": F.lit("rs"), "dir": F.lit("")})
    top = ops.top_hits(ops.score(ops.as_hits(ops.capped_probe(many, "alpha", 3), "rg-global")))
    plan = ops.with_context(top, many)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("BroadcastExchange" in line and "body" in line)
    moved = plan[plan.rindex("ShuffledHashJoin") :]
    assert "LeftSemi" in moved


def test_top_files_from_few_ranges(spark, tmp_path):
    """The same best files as scoring everything, from part of the ranges."""
    from siftwell.operators import topk

    rng = random.Random(9)
    rows = []
    for i in range(900):
        body = rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(5, 60)) + ["rare"] * (i % 97 == 0) + ["often"] * rng.choice((0, 1, 1, 1, 12 if i % 50 == 0 else 1))
        rows.append((f"f{i:03d}", " ".join(body)))
    docs = spark.createDataFrame(rows, "path string, body string").repartition(4)
    topk.write(index.positional_postings(docs), str(tmp_path / "ix"))
    n, total = index.doc_stats(docs).selectExpr("count(*)", "sum(dl)").first()
    for query in ("rare often", "often", "rare", "w1 w2 w3", "nothing", "nothing rare"):
        found = [tuple(r) for r in topk.top(spark, str(tmp_path / "ix"), query, 5, n, total).collect()]
        assert found == [tuple(r) for r in index.best(index.bm25(docs, query), 5).collect()], query
    kept, _ = topk.kept_ranges(spark, str(tmp_path / "ix"), "rare often", 5, n, total)
    assert 0 < kept.count() < 900 / topk.RANGE / 2


def test_one_pass_over_the_bodies(spark, files):
    """Ranking without a stored index tokenises each file once, and a file's tokens are counted where it lies."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def look(body):
        seen.add(1)
        return body

    watched = files.select("path", F.udf(look, "string")("body").alias("body"))
    assert index.bm25(watched, '"alpha beta" [gam TO *] delta').count() and seen.value == files.count()
    assert "Aggregate" not in index.postings(files)._jdf.queryExecution().optimizedPlan().toString()
    twice = files.select("path", "body").union(files.select("path", "body"))
    assert {(r.token, r.path, r.tf) for r in index.postings(twice).collect()} == {(r.token, r.path, 2 * r.tf) for r in index.postings(files).collect()}


@pytest.mark.parametrize("most_sent", [0, 100])
def test_a_stored_index_of_many_files(spark, tmp_path, monkeypatch, most_sent):
    """Changed and gone files beyond one word of bits, files without tokens, merges; the postings of a file lie in one place."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(index, "MOST_SENT", most_sent)
    monkeypatch.setattr(index, "MOST_SEGMENTS", 2)
    rng = random.Random(8)
    held = {}
    for i in range(4):
        held = {p: b for p, b in held.items() if rng.random() < 0.8}
        held |= {f"f{j}": " ".join(rng.choices(WORDS, k=rng.randrange(0, 5))) for j in rng.sample(range(300), 120)} | {"dots": "..." * i, "none": None}
        files = spark.createDataFrame(list(held.items()), "path string, body string").repartition(3)
        kept = index.Index(spark, str(tmp_path / "ix"))
        kept.refresh(files)
        wanted = {(r.token, r.path, r.tf, r.dl, tuple(r.positions)) for r in index.positional_postings(files).collect()}
        found = [(r.token, r.path, r.tf, r.dl, tuple(r.positions)) for r in kept.postings().collect()]
        assert len(found) == len(wanted) and set(found) == wanted
        assert kept.version.n == len(held) and {r.path for r in kept.files.collect()} == set(held)
        for query in ("alpha -beta", '"alpha beta" OR gamma', "* AND bet", "[bet TO delta}"):
            assert sorted(map(tuple, kept.matches(query).collect())) == sorted(map(tuple, index.bm25(files, query).collect())), query
        if i == 0:
            rows = kept._segment(kept.version.segments[0]).withColumn("file", F.input_file_name())
            assert rows.select("number", "file").distinct().count() == len(held)
            assert not rows.where("token IS NOT NULL AND path IS NOT NULL").count()


def test_a_folder_of_another_format_is_filled_anew(spark, tmp_path):
    folder = tmp_path / "ix"
    (folder / "versions").mkdir(parents=True)
    (folder / "versions" / "00000003.json").write_text('{"number": 3, "segments": ["old"], "n": 1, "total": 1}')
    files = spark.createDataFrame([("a.rs", "alpha")], "path string, body string")
    kept = index.Index(spark, str(folder))
    assert not kept.postings().count()
    assert kept.refresh(files) == {"added": 1, "changed": 0, "removed": 0} and kept.version.number == 4
    assert [r.path for r in index.Index(spark, str(folder)).matches("alpha").collect()] == ["a.rs"]
