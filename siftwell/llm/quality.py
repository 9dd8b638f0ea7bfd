"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics come from whole texts, one row a document. The cosine features approximate a Gaussian kernel; each partition
sums its part of the normal equations, so the driver sees fixed-size sums only. The ridge scores are then made into
probabilities by pooling adjacent violators over the training rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import drop, map_text, store

FEATURES = 256
RIDGE = 1.0
WIDTH = 4.0
"""Width of the Gaussian kernel, in standard deviations of the statistics."""
TRAIN_ROWS = 50_000
"""Most labelled documents to fit on, chosen by a hash of doc_id; all documents are scored."""
FIT_PARTS = 8
SEED = 7
KEEP = 0.3
"""Least score of a document predicted to be good."""

NAMES = ("log_words", "log_chars", "word_len", "word_len_sd", "lower", "upper", "digit", "punct", "symbol", "pipe", "bang", "space", "newline", "distinct", "dup_lines", "line_len", "stopish", "top_word", "caps_words", "symbol_words", "beyond", "top_pair", "deflate")
_CLASSES = np.zeros(256, np.int64)
for _group, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "#$%&*<>@^~=+_/\\{}[]`", "|", "!", " \t", "\n\r"), start=1):
    for _c in _chars.encode():
        _CLASSES[_c] = _group
_CLASSES[128:] = 10
_SYMBOLS = re.compile(rb"[#$%&*|<>!]{2,}")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; an empty one has zeros. The order is that of NAMES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=11) / size
    lens = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values())
    pairs: dict[tuple, int] = {}
    for p in zip(words, words[1:], strict=False):
        pairs[p] = pairs.get(p, 0) + 1
    caps = sum(w.isupper() for w in counts) / len(counts)
    return [
        np.log1p(n), np.log1p(size), lens.mean(), min(lens.std(), 20.0), *kinds[1:10].tolist(), len(counts) / n,
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), float((lens <= 3).mean()), top / n, caps,
        len(_SYMBOLS.findall(raw)) / n, float(kinds[10]), max(pairs.values(), default=0) / n, len(zlib.compress(raw, 1)) / (size + 50),
    ]


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from. A null doc_id is not in it, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and x, the statistics of the whole text."""
    return map_text(docs, keep, {"x": "array<double>"}, lambda: lambda texts: [[statistics(t) for t in texts]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and levels of the rising function nearest to the labels: neighbours that fall are pooled."""
    order = np.lexsort((label, score))
    blocks: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s1, y1, n1 = blocks.pop()
            s0, y0, n0 = blocks.pop()
            blocks.append([(s0 * n0 + s1 * n1) / (n0 + n1), y0 + y1, n0 + n1])
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """A model from train (doc_id, x, label). At most about `rows` rows are used, chosen by a hash of doc_id; only sums and
    (score, label) of those rows reach the driver. Without rows, or with one label, every score is that label's share."""
    total = train.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(total, 1)))
    used = store(train.where(part).select("doc_id", "x", "label").repartition(FIT_PARTS, "doc_id").sortWithinPartitions("doc_id", "label"))
    d = len(NAMES)
    model = Model(np.zeros(d), np.ones(d), np.zeros((d, features)), np.zeros(features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    ends = used.select(*(f(F.get("x", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop)), F.avg("label")).first()
    if ends[-1] is None:
        return model
    model.mean = np.array(ends[0:-1:2], float)
    model.scale = np.maximum(np.array(ends[1:-1:2], float), 1e-6)
    rng = np.random.default_rng(seed)
    model.waves = rng.normal(size=(d, features)) / width
    model.phase = rng.uniform(0, 2 * np.pi, features)
    model.levels = np.full(1, float(ends[-1]))
    shape = (features + 2, features + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            z = model.features(np.stack(b["x"].to_list()))
            total[:-1] += z.T @ z
            total[-1] += b["label"].to_numpy(float) @ z
        yield pd.DataFrame({"s": [total.tobytes()]})

    parts = [np.frombuffer(r.s).reshape(shape) for r in used.select("x", "label").mapInPandas(sums, "s binary").collect()]
    whole = np.sum(parts, axis=0)
    model.weights = np.linalg.solve(whole[:-1] + ridge * np.eye(features + 1), whole[-1])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": model.raw(np.stack(b["x"].to_list())), "y": b["label"].to_numpy(float)})

    found = used.select("x", "label").mapInPandas(scored, "s double, y double").toArrow()
    model.steps, model.levels = isotonic(found["s"].to_numpy(), found["y"].to_numpy())
    drop(used)
    return model


def apply(model: Model, measured: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and score for each row of measured (x)."""

    def start():
        return lambda xs: [model.score(np.array(xs, float).reshape(-1, len(NAMES)))]

    return map_text(measured, keep, {"score": "double"}, start, text="x", slab=5000)


def score_texts(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and score, from texts in one step."""

    def start():
        return lambda texts: [model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))]

    return map_text(docs, keep, {"score": "double"}, start)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", keep_from: float = KEEP) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Learns from labels (doc_id, label) of rows outside the held-out fold. Scores depend on the text alone. Null and empty
    texts have the score of an empty text. Null labels and labels of unknown documents are not used; repeated labels each
    count. Repeated rows each come back. Without labels every score is 0.5. Extra columns are ignored; an empty table
    gives an empty one.
    """
    measured = store(measure(docs, ["doc_id"]))
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(measured.join(known, "doc_id"))
    out = apply(model, measured, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))
