"""Bottom-k near-duplicates against all pairs: real documents, groups of near copies, awkward rows."""

import random
from fractions import Fraction

import pytest

from siftwell.llm import minhash
from siftwell.llm.minhash import least_overlap, least_runs, minhash_components, run_size, shared_runs
from test_jaccard import ODD, brute


def check(spark, rows, k, likeness, **kw):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sid string, n int").repartition(3)
    found = [tuple(r) for r in minhash_components(docs, k, likeness, **kw).collect()]
    wanted = [(d, n, c, d == c) for d, n, c in brute(rows, k, likeness)]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_real_and_awkward_rows(spark, sf):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, real + ODD, 2, Fraction(4, 5))


@pytest.mark.parametrize(("k", "likeness", "retained"), [(2, Fraction(4, 5), 64), (5, Fraction(9, 10), 48), (1, Fraction(1, 2), 256)])
def test_groups_of_near_copies(spark, k, likeness, retained):
    """Chains and stars of edits, with and without their centre, and a passage that many share; sets below and above a sketch."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for g, size in enumerate((20, 60, 75, 120, 300, 500)):
        base = rng.choices(words, k=size)
        now = list(base)
        for i in range(12):
            text = list(base if g % 2 else now)
            for _ in range(rng.randrange(1 + size // 15)):
                text[rng.randrange(size)] = rng.choice(words)
            now = text
            if i or g > 2:
                rows.append((len(rows) * 7 % 101, " ".join(text)))
    rows += [(500 + i, " ".join(rng.choices(words, k=rng.randrange(3, 50))) + " " + passage) for i in range(30)]
    check(spark, rows, k, likeness, retained=retained)


def test_a_union_sketch_samples_the_union(spark):
    """Its share of common values is near the likeness of the whole sets, at any size."""
    rng, pairs = random.Random(3), []
    for n in (30, 64, 200, 3000):
        a = [f"a{rng.random()}" for _ in range(n)]
        cut = n // 9
        pairs.append((" ".join(a), " ".join(a[:-cut] + [f"b{i}" for i in range(cut)]), (n - cut) / (n + cut)))
    docs = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    held = {r.doc_id: r for r in minhash.sketches(docs, 1, 64).collect()}
    for i, (_, _, true) in enumerate(pairs):
        a, b = held[2 * i].sketch, held[2 * i + 1].sketch
        union = sorted({*a, *b})[:64]
        assert a == sorted(a) and len(a) == min(64, held[2 * i].n)
        assert abs(len({*union} & {*a} & {*b}) / len(union) - true) < 0.2


def test_least_overlap_is_a_tail():
    rng = random.Random(9)
    least = least_overlap(64, Fraction(4, 5), 1e-3)
    below = sum(sum(rng.random() < 0.8 for _ in range(64)) < least for _ in range(5000))
    assert 30 < least < 51 and below < 15
    assert least_overlap(64, Fraction(1)) == 64


@pytest.mark.parametrize("likeness", [Fraction(4, 5), Fraction(1, 2), Fraction(9, 10)])
def test_open_pairs_lose_no_link(spark, likeness):
    rng = random.Random(12)
    held = []
    for g in range(12):
        base = rng.sample(range(300), rng.randrange(1, 120))
        for _ in range(9):
            s = set(base) - set(rng.sample(base, rng.randrange(0, max(1, len(base) // 6)))) | {rng.randrange(400) for _ in range(rng.randrange(0, max(1, len(base) // 8)))}
            held.append(sorted(s) or [1])
    label = [b"x" if i % 5 == 0 else str(i).encode() for i in range(len(held))]
    sets = spark.createDataFrame([(i, len(t), bytearray(label[i]), t) for i, t in enumerate(held)], "num long, n long, label binary, tokens array<long>").repartition(3)
    found = {frozenset((r.a, r.b)) for r in minhash.open_pairs(sets, likeness).collect()}
    linked, tried = set(), 0
    for i, s in enumerate(map(set, held)):
        for j, t in enumerate(map(set, held[:i])):
            tried += 1
            if label[i] != label[j] and len(s & t) >= likeness * len(s | t):
                linked.add(frozenset((i, j)))
    assert linked <= found and len(linked) > 20 and len(found) < tried / 3


def test_shared_runs_of_small_sets():
    """No arrangement of the values that differ leaves fewer common runs than promised."""
    for likeness in (Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)):
        run = run_size(48, likeness)
        for n in range(2, 14):
            for mask in range(1 << n):
                common = [not mask >> i & 1 for i in range(n)]
                if sum(common) >= likeness * n and mask:
                    found = sum(all(common[i : i + run]) for i in range(n - run + 1))
                    assert found >= max(1, shared_runs(n, run, likeness))


def test_least_runs_is_a_tail():
    rng = random.Random(4)
    least = least_runs(48, 2, Fraction(4, 5), 1e-3)
    below = 0
    for _ in range(5000):
        common = [rng.random() < 0.8 for _ in range(48)]
        below += sum(a and b for a, b in zip(common, common[1:], strict=False)) < least
    assert 8 < least < 30 and below < 15


def test_empty_table(spark):
    assert not minhash_components(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_a_shared_passage_and_a_group_cost_few_pairs(spark, monkeypatch):
    """Pairs verified grow with documents, not with their square, for copies of one text and for a passage that all share."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + " " + passage) for i in range(600)]
    base = [f"c{i}" for i in range(300)]
    for i in range(300):
        text = list(base)
        # Every third copy has changed too much to be linked with any other.
        for j in range(30 if i % 3 == 1 else 1):
            text[(j * 9 + rng.randrange(9)) % 300] = f"x{i}_{j}"
        rows.append((5000 + i, " ".join(text)))
    verified, real = [], minhash._verify

    def counting(pairs, *rest):
        verified.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(minhash, "_verify", counting)
    found = {r.doc_id: r.component_id for r in minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == {i: i if i < 5000 or i % 3 == 0 else 5000 for i, _ in rows}
    assert sum(verified) < 3 * len(rows)
