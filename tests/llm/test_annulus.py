"""Clusters against every vector compared to every centroid in Python's whole numbers; the search against brute force."""

import hashlib
import math

import numpy as np
import pytest

from siftwell.llm.annulus import EXACT, LARGEST, Annulus, centroid_clusters


def brute(rows, k, size, rounds, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < LARGEST / 256 for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return [(i, j, d, sum(e for _, e, c in found if c == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def same(df, wanted):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_clusters_with_awkward_rows(spark, spread):
    """Vectors on a coarse grid: many ties, repeated vectors, empty clusters."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(draw.normal(0, 3, 3)) * spread]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0])]
    rows += [(404, [math.nan, 1.0, 1.0]), (405, [math.inf, 1.0, 1.0]), (406, [1.0, -math.inf, 1.0]), (407, [1e300, 1.0, 1.0]), (408, [1.0, 2.0, 3.0, 4.0]), (409, [LARGEST / 256 - 1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    for k, rounds in ((12, 5), (1, 2), (500, 1)):
        same(centroid_clusters(table, k=k, size=3, rounds=rounds), brute(rows, k, 3, rounds))


def test_nothing_to_cluster(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    none = centroid_clusters(table)
    assert not none.collect() and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert not centroid_clusters(table.where("vec_id > 5"), size=1).collect()
    assert len(centroid_clusters(table, size=1).collect()) == 1


@pytest.mark.parametrize(("scale", "kind"), [(1, "ties"), (256, "normal"), (EXACT, "large"), (200, "like norms")])
def test_search_equals_all_comparisons(scale, kind):
    draw = np.random.default_rng(scale)
    for size in (1, 2, 16):
        x, c = (draw.normal(0, 2, (n, size)) for n in (500, 37))
        if kind == "like norms":
            x, c = x / np.linalg.norm(x, axis=1)[:, None], c / np.linalg.norm(c, axis=1)[:, None]
        x, c = (np.floor(y * scale).astype(np.int64) for y in (x, c))
        c[5], c[20] = c[30], c[30]
        number, distance = Annulus(c).nearest(x)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_search_compares_few(monkeypatch):
    """Centroids whose norms are far from a vector's are not compared."""
    c = np.arange(1, 201)[:, None] * np.array([[1000, 0]])
    x = np.stack([np.arange(500, 200_000, 1000), np.full(200, 3)], axis=1)
    search, seen = Annulus(c), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    real = np.ndarray.astype
    number, _ = search.nearest(x)
    x2 = x.view(Counted)
    assert real(x2, np.float64).__class__ is Counted
    again, _ = search.nearest(x2)
    assert (number == again).all() and sum(seen) < 8 * len(x) < len(c) * len(x)
