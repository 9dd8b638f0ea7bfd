"""Resampling against a plain computation of features, gains, noise and ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from siftwell.llm.resampling import bucket_counts, gains, pieces, resample

ODD = [
    (None, "a null id that has rather many words so that it could be drawn from all of these at least once or even twice"),
    (900, None), (901, ""), (902, " \t\n ,.; "), (903, "one"), (904, "a\0b c\0"), (905, "É é ÀB ab日本 x-y 'z' \x7f 1a2 ~"), (906, "word " * 19), (907, "word " * 20),
    (907, "word " * 20), (907, "Word " * 20), (908, "w1 " * 40_000), (909, "x" * 50_000 + " y"),
]


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(g.encode()) % 10000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])


def brute(rows, target, percent=25, least=20):
    held, s, t = [(i, *features(x)) for i, x in rows], Counter(), Counter()
    for _, _, c in held:
        s.update(c)
    for x in target:
        t.update(features(x)[1])
    whole, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in range(10000)]
    out = []
    for i, n, c in held:
        m = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // m if m else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, m, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for at, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r[:4], []).append(at + 1)
    return [(*r[:4], ranks[r[:4]].pop() if r[4] and ranks.get(r[:4]) else None) for r in out]


def same(df, wanted):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(wanted, key=str)


def test_real_and_awkward_rows(spark, sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, "x") for r in real + ODD], "doc_id long, text string, rank int, buckets string").repartition(4)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    same(resample(docs, aimed), brute(real + ODD, target))
    same(resample(docs, aimed.where("false"), percent=100, least_words=1), brute(real + ODD, [], 100, 1))


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "same words again " * 8)] * 50 + [(None, "same words again " * 8)] * 3, "doc_id long, text string")
    aimed = spark.createDataFrame([("same words",)], "text string")
    found = resample(docs, aimed).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 14)) and len({r.weight for r in found}) == 1
    assert not resample(docs.where("doc_id > 9"), aimed).collect()


def test_counts_are_those_of_each_text(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)
    for r in bucket_counts(docs.select("doc_id", "text").where("doc_id <> 907")).collect():
        text = dict((i, t) for i, t in ODD)[r.doc_id]
        assert dict(zip(r.buckets, r.counts, strict=True)) == features(text)[1] and r.buckets == sorted(r.buckets)


def test_long_texts_come_in_pieces(spark):
    """Pieces share a word each, and counts are those of the whole text."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab1É .,\0\n", k=rng.randrange(0, 90))) for _ in range(300)] + ["x" * 70, "x" * 30 + " " * 60 + "y", " " * 80, "a b " * 40, "a " + "z" * 90 + " b c", " " * 50 + "a"]
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    for text in texts:
        cut = pieces(text, 7)
        w = [word.findall(p) for p, _ in cut]
        assert [c for _, c in cut] == [False] + [True] * (len(cut) - 1)
        assert all(a[-1] == b[0] for a, b in zip(w, w[1:], strict=False))
        assert [x for i, p in enumerate(w) for x in p[i > 0 :]] == word.findall(text)
    assert len(pieces("a b " * 40, 7)) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bucket_counts(docs, piece=7).collect():
        assert dict(zip(r.buckets, r.counts, strict=True)) == features(texts[r.doc_id])[1]


def test_gains_are_floored():
    raw, target = np.array([0, 5, 100]), np.array([3, 0, 1])
    assert gains(raw, target).tolist() == [math.floor(1000 * math.log((b + 1) * 108 / ((a + 1) * 7))) for a, b in zip((0, 5, 100), (3, 0, 1), strict=True)]
