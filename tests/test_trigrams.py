"""Trigram queries never rule out a match; pruned probes equal scans and read fewer files."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators import search as ops, trigrams

QUERIES = {
    "login_user": ("and", ("_us", "gin", "in_", "log", "n_u", "ogi", "ser", "use")),
    "ab": True, "abc": "abc", "abc|xyz": ("or", ("abc", "xyz")), "abc|.": True, "(abc)?def": "def", "(abc)+": "abc", "ab[cd]": ("or", ("abc", "abd")), "abc.*def": ("and", ("abc", "def")),
    "^ABC$": "abc", "(?i)abc": True, "a(b|c)d": ("or", ("abd", "acd")), "[a-z]bc": True, "(": True, "ABÉ": True, "x{0,2}abc": "abc", r"\bfoo\b": "foo",
}


@pytest.mark.parametrize("pattern", QUERIES)
def test_queries(pattern):
    assert trigrams.of_pattern(pattern) == QUERIES[pattern]


def holds(query, held):
    if query is True:
        return True
    if isinstance(query, str):
        return query in held
    return (all if query[0] == "and" else any)(holds(p, held) for p in query[1])


PART = st.sampled_from(["a", "b", "ab", "abc", "[ab]", "[^a]", ".", "(ab|ba)", "(abc|)", "a?", "b+", "(ab)*", "(ba){2}", "^", "$", "\\b", "(a|bc|abb)", "B", "[a-c]", "É", "(?:abc|cab)+", "a{2,3}"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, min_size=1, max_size=6), st.text("abcABÉ ", max_size=14))
def test_no_match_is_ruled_out(parts, text):
    pattern = "".join(parts)
    if re.search(pattern, text):
        assert holds(trigrams.of_pattern(pattern), trigrams.grams(text.lower()))


def test_pruned_probes_equal_scans(spark, tmp_path):
    rng = random.Random(3)
    bodies = ["\n".join("".join(rng.choices("abcdE é", k=9)) for _ in range(rng.randrange(0, 9))) for _ in range(60)] + [None, "", "ab", "xxneedle_1xx\r\nNeedle_1"]
    files = spark.createDataFrame([(f"f{i}", "rs", b) for i, b in enumerate(bodies)], "path string, ext string, body string").repartition(4)
    trigrams.write(files, str(tmp_path / "ix"))
    held = trigrams.read(spark, str(tmp_path / "ix"))
    for symbol, fold in (("needle_1", False), ("needle_1", True), ("abc", False), ("ab", False), ("cdE", True), ("nowhere", False), (" é", False)):
        same = [sorted(map(tuple, df.collect())) for df in (trigrams.pruned_probe(files, held, symbol, fold), ops.probe(files, symbol, fold))]
        assert same[0] == same[1], symbol
    assert trigrams.pruned(files, held, trigrams.of_text("needle_1")).count() == 1
    assert trigrams.pruned(files, held, trigrams.of_text("abc"), most=0).count() == sum("abc" in (b or "").lower() for b in bodies)
    plan = trigrams.candidates(held, trigrams.of_text("needle_1"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
