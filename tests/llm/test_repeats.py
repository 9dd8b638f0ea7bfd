"""Repeat removal against a table of all strings; small lengths and groups so that every path runs."""

import random
from collections import Counter

import pytest

from siftwell.llm.repeats import Anchors, _same, maximal_repeats, remove_repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(i, j) for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]) for j in [next((j for j in range(i, len(r)) if not gone[j]), len(r))]]
        out.append((len(r), [a for a, _ in runs], [b for _, b in runs], bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(3)
    found = remove_repeats(docs.selectExpr("doc_id", "text", "k1"), ["doc_id", "text"], **kw).collect()
    got = sorted(((r.text or "", r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept)) for r in found))
    assert got == sorted((t or "", *b) for t, b in zip(texts, brute(texts, kw["length"]), strict=True))


def mixed(n, seed):
    """Texts from random pieces: shared passages with different surroundings, copies, near copies, runs of one letter."""
    rng = random.Random(seed)

    def fresh(k):
        return "".join(rng.choice("abcdeé ") for _ in range(k))

    hot, other = fresh(150), fresh(90)
    out = [None, "", "short", "z" * 200, "ab" * 130]
    for i in range(n):
        kind = i % 6
        at = rng.randrange(40)
        text = fresh(rng.randrange(20, 200)) + (hot[at:] if kind < 3 else other if kind < 5 else "") + fresh(rng.randrange(80))
        out.append(text if kind != 5 else text * 2)
        if kind == 1:
            out += [text, text[:60] + "!" + text[60:]]
    return out


@pytest.mark.parametrize("group", [1000, 4])
def test_mixed_texts(spark, group):
    run(spark, mixed(60, 1), length=60, k=16, group=group)


def test_nothing_and_little(spark):
    run(spark, [None, "", "a"], length=60, k=16)
    run(spark, ["q" * 59, "q" * 59], length=60, k=16)
    run(spark, ["q" * 60, "p" + "q" * 60], length=60, k=16)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not remove_repeats(docs, ["doc_id"]).collect()


def test_kept_columns_of_any_name_and_periodic_text(spark):
    rows = [(1, "a" * 3000, 5, "x", "blob"), (2, "xyz" * 1000, 6, "y", "b"), (3, "abcdefghij" * 20, 7, "z", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k1 long, _row string, _spans string")
    found = {r.doc_id: r for r in remove_repeats(docs, ["doc_id", "_k1", "_row", "_spans", "text"]).collect()}
    assert {i: (r._k1, r._row, r._spans, r.text) for i, r in found.items()} == {r[0]: (r[2], r[3], r[4], r[1]) for r in rows}
    assert [len(found[i].kept) for i in (1, 2, 3)] == [0, 0, 200]


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    run(spark, texts, length=400)


def test_maximal_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted({("".join(rng.choice("ab") for _ in range(12)).encode(), "".join(rng.choice("ab") for _ in range(12)).encode()) for _ in range(rng.randrange(2, 40))}, key=lambda r: r[1])
        lefts, rights = [r[0] for r in rows], [r[1] for r in rows]
        found = maximal_repeats(lefts, rights, 9)
        for i in range(len(rows)):
            want = {s for j in range(len(rows)) if j != i for s in range(13) if _same(lefts[i], lefts[j]) >= s and _same(rights[i], rights[j]) >= 9 - s >= 0}
            have = {s for a, b in found[i] for s in range(13) if a >= s and b >= 9 - s >= 0}
            assert have == want


def test_anchors_are_few_and_lie_in_every_string():
    rng = random.Random(5)
    raw = bytes(rng.randrange(97, 123) for _ in range(20000))
    find = Anchors(400, 32)
    at, h = find(raw)
    assert len(at) < 3 * len(raw) / 370
    for start in range(0, len(raw) - 400, 97):
        inside, hashes = find(raw[start : start + 400])
        known = dict(zip(at.tolist(), h.tolist(), strict=True))
        assert len(inside) >= 1 and all(known.get(start + p) == x for p, x in zip(inside.tolist(), hashes.tolist(), strict=True))
