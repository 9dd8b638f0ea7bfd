"""Targets against the stated resharing loop; the mix against its bounds, totals and reruns."""

import random
from collections import defaultdict

import pytest

from siftwell.llm import mixing
from siftwell.llm.mixing import mix_sources


def targets(sizes):
    """Shares by weight; what is above three times a source's size is shared again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {s: 3 * sizes[s] for s in names}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap[s] + 1e-9}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    return out


def check(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6
    assert len(rows) == docs.count()


def test_real_documents_and_small_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for block in (512, 4):
        first = sorted(mix_sources(docs, block=block).collect(), key=str)
        assert first == sorted(mix_sources(docs.repartition(5), block=block).collect(), key=str)
        check(docs, first)


def test_awkward_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot") for i in range(300)] + [(None, None, None), (1, "", None), (2, "a b c", None), (2, "a b c", None), (7, "x", "é"), (8, "y z", "Z"), (9, " ", "empty source")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS target", "2 AS block", "3 AS p")
    check(docs, mix_sources(docs, block=16).collect())


def test_nothing_to_take(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix_sources(docs).collect()] == [(0.0, 0)] * 2
    assert not mix_sources(docs.where("doc_id > 5")).collect()


def test_flight_keeps_both_sums():
    p, size = [0.3, 0.55, 0.8, 0.1, 0.5, 0.25, 0.5], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    q = mixing._flight(p, size)
    assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, size, strict=True)))
    assert sum(0 < x < 1 for x in q) <= 2


def test_flight_of_any_sizes_ends_with_two_fractions():
    draw = random.Random(11)
    for n in (0, 1, 2, 3, 5, 40, 300):
        for top in (1, 2, 3, 1000):
            p, size = [draw.choice((draw.random(), 0.0, 1.0)) for _ in range(n)], [float(draw.randrange(top)) for _ in range(n)]
            q = mixing._flight(p, size, n)
            assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
            assert sum(q) == pytest.approx(sum(p), abs=1e-6) and sum(a * b for a, b in zip(q, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, size, strict=True)), abs=1e-3)
            assert q == mixing._flight(p, size, n)


def test_a_long_document_does_not_spoil_the_total():
    """Of 60 short documents and a few very long ones the words taken come near what is due."""
    draw, off = random.Random(2), []
    for seed in range(60):
        size = [5000.0, 3000.0, 2500.0] + [float(draw.randrange(20, 700)) for _ in range(60)]
        p = [0.3] * len(size)
        q = mixing._landing(mixing._flight(p, size, seed), size)
        off.append(abs(sum(a * b for a, b in zip(q, size, strict=True)) - 0.3 * sum(size)) / (0.3 * sum(size)))
    off.sort()
    assert off[len(off) // 2] < 0.01 and off[int(0.9 * len(off))] < 0.03


def test_sources_come_near_their_targets(spark, sf):
    """Nine sources of ten within 3 % of their targets, or half of their shortest documents."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    by = defaultdict(lambda: [0, 0.0])
    for r in mix_sources(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        by[r[0]] = [r["sum(taken)"], r["max(target)"]]
    good = sum(abs(t - x) <= 0.03 * x + 1 for t, x in by.values())
    assert good >= 0.9 * len(by), by


@pytest.mark.parametrize("rate", [0.3, 0.6])
def test_long_and_short_documents_are_taken_alike(rate):
    draw, each = random.Random(5), []
    for block in range(60):
        size = [float(round(draw.lognormvariate(5, 1)) + 1) for _ in range(512)]
        each += zip(size, mixing._flight([rate] * 512, size, block), strict=True)
    each.sort()
    for i in range(5):
        fifth = [p for _, p in each[i * len(each) // 5 : (i + 1) * len(each) // 5]]
        assert sum(fifth) / len(fifth) == pytest.approx(rate, abs=0.025)
