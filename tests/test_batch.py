"""Many symbols at once against single searches."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import rewrite
from siftwell.operators import batch, search as ops
from siftwell.plans.search import Engine, SearchSpec

BODIES = {
    "src/login_user.rs": "fn login_user() {\r\n  login_user::<T>();\nlogin_user error login_user\n}\nUser.login_user\n",
    "src/x.y.rs": "use x.y;\nx-y x.y x_1 X_1\n",
    "src/xay.rs": "x.y again\n" * 30,
    "src/other.rs": "LOGIN_USER a+b useThing( UserCard\n\n\nuseThing<T\n",
    "web/UserCard.tsx": "<UserCard />\nUserCardProps É é_1\nconst UserCard = 1\n",
    "empty.rs": "", "null.rs": None,
}
SYMBOLS = ["login_user", "x.y", "a+b", "UserCard", "useThing", "useThing(", "x_1", "_1", "absent", "no.where", "É", "UserCard />", "login_user error", " x.y ", "", None, "again\nx.y", ".", "e"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, p.rpartition("/")[0], p.rpartition("/")[2], p.rpartition(".")[2], b, len(b or "")) for p, b in BODIES.items()]
    return spark.createDataFrame(rows, "path string, dir string, name string, ext string, body string, n_bytes long").repartition(3)


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")


@pytest.mark.parametrize("language", [None, "rust", "tsx"])
def test_a_pass_equals_single_probes(spark, files, symbols, language, monkeypatch):
    found = {(r.symbol, r.path, r.line_no): r.variants for r in batch.batch_probe(files, symbols, language).collect()}
    wanted = {}
    for s in {s.strip() for s in SYMBOLS if s and s.strip()}:
        fold = rewrite.insensitive(s, language)
        texts = rewrite.variants(s, language)
        for r in ops.probe(files, s, fold).collect():
            line = r.line.lower() if fold else r.line
            wanted[s, r.path, r.line_no] = [i for i, t in enumerate(texts) if (t.lower() if fold else t) in line]
    assert found == wanted
    monkeypatch.setattr(batch, "CHARACTERS", 150)
    again = {(r.symbol, r.path, r.line_no): r.variants for r in batch.batch_probe(files, symbols, language).collect()}
    assert again == found


def test_variants_are_the_rewrites(spark):
    names = [s.strip() for s in SYMBOLS if s and s.strip()]
    for language in (None, "rust", "swift", "ts"):
        rows = rewrite.rewritten(spark.createDataFrame([(n,) for n in names], "symbol string"), language)
        escaped = {(r.symbol, r.pos): r.query for r in rows.collect()}
        import re

        assert escaped == {(n, i): re.sub(r"([\\.+*?^$()\[\]{}|])", r"\\\1", t) for n in names for i, t in enumerate(rewrite.variants(n, language))}


def test_stages_equal_single_searches(spark, files, symbols):
    best = batch.top_of_each(batch.batch_search(files, symbols, None, 4)).collect()
    found = {}
    for r in sorted(best, key=lambda r: r["rank"]):
        found.setdefault(r.symbol, []).append((r.stage, r.path, r.line_no, round(r.score, 6)))
    for s in ("login_user", "x.y", "a+b", "useThing(", "absent", "UserCard />"):
        one = Engine(spark, files).search(SearchSpec(s, max_matches=4, use_structure=False))
        assert found.get(s, []) == [(one.stage, t["path"], t["line_no"], round(t["score"], 6)) for t in one.top_hits], s


def test_the_best_of_each_are_cut_before_they_move(files, symbols):
    plan = batch.named_files(files, ["x.y"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan or "GroupLimit" in plan
    assert [r.path for r in batch.named_files(files, ["x.y", "."], 3).where(F.col("symbol") == "x.y").orderBy("pos").collect()] == ["src/x.y.rs", "src/xay.rs"]


def test_a_task_holds_few_hits(spark, monkeypatch):
    """A body of many hits is handed on piece by piece, and of each symbol the first lines are kept."""
    monkeypatch.setattr(batch, "AT_ONCE", 7)
    body = "\n".join(f"ab cd {i}" for i in range(100))
    assert len(list(batch._found(batch._automaton(("ab", "cd")), body, [[(0, 0)], [(1, 0)]], 3))) == 6
    held = spark.createDataFrame([(f"{j}.rs", f"{j}.rs", "rs", body) for j in range(5)], "path string, name string, ext string, body string").coalesce(1)
    found = batch.batch_probe(held, spark.createDataFrame([("ab",), ("cd",)], "symbol string"))
    assert found.count() == 1000
    assert {r.line_no for r in found.where("symbol = 'cd' AND path = '3.rs'").collect()} == set(range(1, 101))
    stored = batch.batch_search(held, spark.createDataFrame([("ab",)], "symbol string"))
    assert "InMemory" not in stored._jdf.queryExecution().optimizedPlan().toString()


WORDS = ["a", "ab", "b", "é", "É", "aB", "b.", "x.y", "", "ba\r"]


@pytest.fixture(scope="module")
def many(spark):
    """Files of few words, so that most symbols have many hits; some paths come twice."""
    rng = random.Random(3)
    bodies = [None if i == 5 else "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "\r\n"]) for _ in range(rng.randrange(0, 30))) for i in range(60)]
    rows = [(f"d/{i % 55:02d}.x.ys", f"{i % 55:02d}.x.ys", "ys", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "path string, name string, ext string, body string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(s,) for s in (*SYMBOLS, "a", "ab", "a b", "a b a", "a  b", "ab é", "b\r", "b\r a", "B", "y a", "x.", ".x", "b.", "s", "é a")], "symbol string")


@pytest.mark.parametrize("language", [None, "rust"])
def test_counts_are_those_of_all_hits(spark, many, asked, language, monkeypatch):
    monkeypatch.setattr(batch, "BYTES", 60)
    for files in (many, many.where("path >= 'd/05'").dropDuplicates(["path"])):
        wanted = {}
        for s in {r.symbol.strip(" ") for r in asked.collect() if r.symbol and r.symbol.strip(" ")}:
            hits = ops.probe(files, s, rewrite.insensitive(s, language)).collect()
            if hits and "\n" not in s:
                wanted[s] = (len(hits), len({r.path for r in hits}), min(r.path for r in hits))
        counted = batch.batch_counts(files, asked, language)
        assert {r.symbol: tuple(r)[1:] for r in counted.collect()} == wanted
    plan = batch.batch_counts(many, asked, language)._jdf.queryExecution().optimizedPlan().toString()
    assert "line_no" not in plan


@pytest.mark.parametrize(("best", "most"), [(1, 3), (2, 1), (2, 20), (5, 20)])
def test_first_hits_hold_the_best(spark, many, asked, best, most, monkeypatch):
    """What tasks leave out is never among the best, and each task hands on few hits of a symbol."""
    monkeypatch.setattr(batch, "BYTES", 60)
    asked = asked.where("symbol NOT LIKE '%\r%'")
    columns = ("symbol", "stage", "path", "ext", "line_no", "variants", "score", "rank")
    found = batch.top_of_each(batch.batch_search(many, asked, None, most, 4, best), best).select(*columns)
    wanted = batch.top_of_each(batch.batch_search(many, asked, None, most, 4), best).select(*columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert batch.first_hits(many, asked, best, None, most).groupBy("symbol").count().agg(F.max("count")).first()[0] == best


def test_words_equal_lines():
    import pyarrow as pa

    from siftwell.operators import words

    rng = random.Random(1)
    for _ in range(150):
        symbols = sorted({s for s in ("".join(rng.choices("ab é\r", k=rng.randrange(1, 6))).strip(" ") for _ in range(20)) if s})
        texts = [rng.choice([None, "", "\n", "\n\n", "".join(rng.choices("aab  é\r\n", k=30))]) for _ in range(6)]
        found = words.Words(symbols).find(pa.array(["a b", *texts, "q"], pa.string())[1:-1])
        lines = [(r, i + 1, x.removesuffix("\r")) for r, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))]
        assert {(r, n, symbols[s]) for r, n, s in zip(found.row[found.line], found.number[found.line], found.symbol, strict=True)} == {(r, n, s) for r, n, x in lines for s in symbols if s in x}
