"""The Jaccard join against all pairs: real documents, groups of near copies, awkward rows."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from siftwell.llm.jaccard import jaccard_components

ODD = [(None, "one two three four five six"), (None, "one two three four five six"), (1, None), (2, ""), (3, " \t "), (4, "a"), (5, "A"), (6, "a b"), (7, "a b"), (7, "a b"), (7, "x y z"), (8, "É é"), (9, "é é"), (10, "w " * 30000)]
ODD += [(20, "a\0b c d e"), (21, "a b c d e"), (22, "\0"), (23, "\0\0 \0"), (24, "a\0 b c"), (25, "a b c"), (26, "\0a b\0 c")]


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


# Words that differ in every byte and whose bytes, weighted by the powers of any odd number, have one sum.
ODD += [(30 + i, w) for i, w in enumerate(x for n in (8, 64, 1024, 2048) for x in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))))]

# Words of eight bytes and more that differ in one byte alone, whichever it is, by a bit that their size has too.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
NEAR = [(size, i, a, b) for size in (8, 9, 10, 12, 16, 17, 24) for i in (0, 6, 7, 8, size - 1) if i < size for a, b in ("ai", "ab", "aq", "ae", "hx")]


def test_long_words_that_differ_in_one_byte(spark):
    rows = []
    for n, (size, i, a, b) in enumerate(NEAR):
        x, y = (LETTERS[:i] + c + LETTERS[i + 1 : size] for c in (a, b))
        rows += [(4 * n, f"{n} {x}"), (4 * n + 1, f"{n} {y}"), (4 * n + 2, f"{n} {x} - {n} {y} - +"), (4 * n + 3, x + " " + y)]
    rows += [(9000, "aaaaaaa?x"), (9001, "aaaaaaa<x\0"), (9002, "aaaaaaaa"), (9003, "aaaaaaaa\0")]
    check(spark, rows, 3, Fraction(9, 10))
    check(spark, rows, 1, Fraction(9, 10))


def brute(rows, k, likeness):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    places: dict = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in places.setdefault(g, []))
        for g in s:
            places[g].append(i)
        for j, both in shared.items():
            if both >= likeness * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)]


def check(spark, rows, k, likeness, **kw):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sid string").repartition(3)
    found = [tuple(r)[:3] for r in jaccard_components(docs, k, likeness, **kw).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, k, likeness), key=str)


def test_real_and_awkward_rows(spark, sf):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, real + ODD, 3, Fraction(9, 10))


@pytest.mark.parametrize(("k", "likeness", "bits"), [(3, Fraction(9, 10), 4), (5, Fraction(4, 5), 18), (1, Fraction(1, 2), 2)])
def test_groups_of_near_copies(spark, k, likeness, bits):
    """Chains and stars of edits, with and without their centre, and a passage that many share."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=20))
    rows = []
    for g in range(6):
        base = rng.choices(words, k=60)
        now = list(base)
        for i in range(14):
            text = list(base if g % 2 else now)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(60)] = rng.choice(words)
            now = text
            if i or g > 2:
                rows.append((len(rows) * 7 % 101, " ".join(text)))
    rows += [(500 + i, " ".join(rng.choices(words, k=rng.randrange(3, 30))) + " " + passage) for i in range(30)]
    check(spark, rows, k, likeness, bits=bits)


def test_empty_table(spark):
    assert not jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect()


@pytest.mark.parametrize("bits", [24, 10])
def test_a_shared_passage_costs_few_pairs(spark, monkeypatch, bits):
    """Documents that share a passage and nothing else: the pairs verified don't grow with the square of their number."""
    from siftwell.llm import jaccard

    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + " " + passage) for i in range(1500)]
    rows += [(5000 + i, rows[i][1].replace("p59", "px")) for i in range(20)]
    verified, real = [], jaccard._verify

    def counting(pairs, *rest):
        verified.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verify", counting)
    found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10), bits=bits).collect()}
    assert found == {i: i if i < 5000 else i - 5000 for i, _ in rows}
    assert sum(verified) < len(rows)
