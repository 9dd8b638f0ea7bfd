"""Centroid clustering of whole-number vectors by annulus search.

Centroids are sorted by norm. By the triangle inequality a centroid nearer to a vector than u has a norm within u of the
vector's, so with an upper bound u (the least distance to a few centroids of like norm) a binary search over the norms gives
the only ones that can be nearest, and those alone are compared, exactly and in whole numbers. Both ends of the annulus
are part of it, so a centroid just as near as the best is compared too, and the smaller number wins.

Rounds read the vectors where they lie. A task sends one row of sums for each cluster and component, so what a round moves
follows from the number of tasks and centroids; centroids are few and known to all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import drop, store

SCALE = 256
LARGEST = 1 << 26
"""Components are less than this: squared distances of vectors of 64 fit a long then, with room for their sums."""
EXACT = 1 << 22
"""Below this, products of 64 components are whole in doubles, and matrices are multiplied as such."""
PROBES = 3
"""Centroids of like norm that a vector is compared to for its bound."""
ROWS = 4096
"""Vectors that are compared at once."""


def whole_vectors(table: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v) of the vectors of `size` components that are finite: floor(SCALE * x) of each, as int.

    Vectors of another size, null ones, ones with a null, NaN or infinite component and ones with a component of LARGEST or
    more, whose squared distances would not fit a long, are left out.
    """
    v = F.col("_v")
    held = table.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    scaled = F.transform(v, lambda x: F.floor(x * SCALE))
    bound = float(LARGEST) / SCALE
    sound = F.forall(v, lambda x: F.coalesce((x < bound) & (x >= -bound), F.lit(False)))
    return held.where((F.size(v) == size) & sound).select("vec_id", scaled.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of "seed:vec_id", in its order. Rows of one id: the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


class Annulus:
    """Centroids by norm, and the search for the nearest."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.largest = int(np.abs(centroids).max(initial=0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; of equally near ones the smallest number."""
        n = len(vectors)
        top = max(self.largest, int(np.abs(vectors).max(initial=0)))
        # Doubles hold these products without loss, or else whole numbers do the work.
        kind = np.float64 if top < EXACT else np.int64
        x, c = vectors.astype(kind), self.centroids[self.order].astype(kind)
        xx, cc = (x * x).sum(axis=1), (c * c).sum(axis=1)
        norm = np.sqrt(xx.astype(np.float64))
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(c))

        def compare(rows: np.ndarray, j: int) -> None:
            d = (xx[rows] - 2 * (x[rows] @ c[j]) + cc[j]).astype(np.int64)
            better = (d < best[rows]) | (d == best[rows]) & (self.order[j] < number[rows])
            at = rows[better]
            best[at], number[at] = d[better], self.order[j]

        like = np.searchsorted(self.norms, norm) - PROBES // 2
        for p in range(min(PROBES, len(c))):
            probe = np.clip(like, 0, len(c) - min(PROBES, len(c))) + p
            for j in np.unique(probe).tolist():
                compare(np.flatnonzero(probe == j), j)
        # Roots are rounded: the annulus is wider by far more than that, and what is compared is exact.
        bound = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-6 + norm * 1e-9
        lo, hi = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        for j in range(int(lo.min(initial=0)), int(hi.max(initial=0))):
            rows = np.flatnonzero((lo <= j) & (j < hi))
            if len(rows):
                compare(rows, j)
        return number, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """How many vectors each centroid has, and the sums of their components."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = Annulus(centroids), np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), size)
                number, _ = search.nearest(x)
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                total[found, :size] += np.add.reduceat(x[order], starts, axis=0)
                total[:, size] += np.bincount(number, minlength=k)
        cluster, place = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(total.ravel())], names=["cluster", "place", "total"])

    parts = vectors.select("v").mapInArrow(add, "cluster long, place long, total long")
    # k * (size + 1) rows at most, whatever the number of vectors.
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    whole = [[0] * (size + 1) for _ in range(k)]
    for r in sums:
        whole[r.cluster][r.place] = int(r.total)
    return np.array([row[size] for row in whole]), [row[:size] for row in whole]


def move(centroids: np.ndarray, counts: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; those without stay."""
    return np.array([[s // int(n) for s in row] if n else old for old, n, row in zip(centroids.tolist(), counts, sums, strict=True)], np.int64)


def centroid_clusters(table: DataFrame, k: int = 40, size: int = 64, rounds: int = 5, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector kept.

    Kept are finite vectors of `size` components (see whole_vectors). Centroids start as k of them and move `rounds` times to
    the floor of the mean of the vectors nearest to them; equally near ones: the smaller number; one without vectors stays.
    distance is squared, inertia its sum over all, cluster_inertia over the cluster (null if beyond a long). Fewer vectors
    than k: as many centroids. Repeated rows each count and each come back; a null vec_id comes last when centroids are
    chosen. Further columns are ignored. Without a vector the result is empty.
    """
    vectors = store(whole_vectors(table, size, key, vector))
    centroids = first_centroids(vectors, k, seed)
    spark = table.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        moved = move(centroids, *_sums(vectors, centroids))
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                number, distance = search.nearest(_matrix(part.column(1), size))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = store(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    drop(vectors)
    # One row for each centroid: k at most.
    total = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    most = (1 << 63) - 1
    known = [(j, *(int(x) if x <= most else None for x in (total.get(j, 0), sum(total.values()))), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
