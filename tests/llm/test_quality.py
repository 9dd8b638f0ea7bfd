"""The classifier: held-out accuracy, the fold, awkward rows, calibration."""

import zlib

import numpy as np

from siftwell.llm.quality import FEATURES, NAMES, isotonic, quality_scores, statistics


def test_held_out_accuracy_and_fold(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_scores(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in test) / len(test) > 0.9
    # Labels of the held-out fold change nothing.
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in known.items()], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "text " * 60, "a"), (2, "text " * 60, "b"), (3, "y" * 100000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert {r.score for r in quality_scores(docs, labels.where("FALSE")).collect()} == {0.5}
    assert not quality_scores(docs.where("FALSE"), labels).collect()


def test_isotonic_pools_what_falls():
    steps, levels = isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert levels.tolist() == [0.0, 0.5, 1.0] and steps.tolist() == [1.0, 2.5, 4.0]


def test_statistics():
    assert len(statistics("a b")) == len(NAMES) and statistics(None) == statistics(" \n") == [0.0] * len(NAMES)
    assert FEATURES > len(NAMES)


def test_fit_equals_one_solution_in_memory(spark, sf):
    """Partition sums and pooling against all rows at once, and the min-max formula of rising functions."""
    import numpy as np
    from pyspark.sql import functions as F

    from siftwell.llm.quality import RIDGE, fit, isotonic, measure, statistics

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = measure(docs, ["doc_id"]).join(labels, "doc_id").cache()
    model = fit(train)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(texts[r.doc_id], r.label) for r in train.collect()]
    x, y = np.array([statistics(t) for t, _ in rows]), np.array([v for _, v in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), atol=1e-9)
    z = np.sqrt(2 / 256) * np.cos(np.clip((x - model.mean) / model.scale, -8, 8) @ model.waves + model.phase)
    z = np.hstack([z, np.ones((len(x), 1))])
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(RIDGE) * np.eye(257)]), np.append(y, np.zeros(257)), rcond=None)[0]
    assert np.allclose(model.raw(x), z @ weights, atol=1e-6)

    score, label = np.random.default_rng(5).normal(size=60), np.random.default_rng(6).integers(0, 2, 60).astype(float)
    steps, levels = isotonic(score, label)
    order = np.lexsort((label, score))
    s, v = score[order], label[order]
    best = [max(min(v[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(np.unique(np.round(levels, 9)), 9)) and np.all(np.diff(steps) > 0)
