"""Mixing sources to target weights by cube-method balanced sampling.

Each document is due a number of copies: its source's target over its source's size. The whole part is certain; the
fraction is an inclusion probability. Within blocks of documents of a source, probabilities move through the null space of
the constraints (sum of tokens, number of documents) until all but two are 0 or 1, long documents first, each step drawn so
that it keeps every document's expectation. What is left of many blocks forms the next round's blocks, until each source has one; its last two
documents are settled by the smallest error.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import WORD, quoted, store

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
"""Most copies of a document."""
BLOCK = 512
"""Documents of a block: what one task holds at once."""
NEAR = 1e-9
SALTS = 64


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes, stored, with each source's rank by code point, null last. Ranges of sources are numbered apart, so no task holds all."""
    ranged = store(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a range meets here.
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return store(ranged.join(F.broadcast(starts), "_part").withColumn("_rank", here + F.col("_start")).drop("_part", "_start"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); sources by code point, null last, weigh in turn.

    All sizes are shared by weight; what exceeds `most` times a source's size is shared again among the others. That ends
    where every source has min(most * size, level * weight). The level rises while a round finds more sources at their
    caps, and each round is one sum over the sources.
    """
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    ranked = _ranked(sizes).withColumns({"_w": weight, "_cap": F.lit(float(most)) * F.col("source_size")})
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") < level * F.col("_w")
        n, held, free = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if n == capped:
            break
        capped = n
        level = (total - held) / free if free else float("inf")
    return ranked.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).drop("_rank", "_w", "_cap")


def _flight(p: list[float], size: list[float], seed: int = 0) -> list[float]:
    """Moves probabilities, two sums kept, until at most two are fractions. Of the two ends of a line one is drawn with
    the odds that keep each expectation. Draws follow from the seed, so reruns agree.

    Documents are settled by falling size, each against all shorter ones that are still open: these share what it gains or
    loses, alpha + beta * size each. So a long document is settled while there are many to balance it, and short ones are
    what is left.
    """
    p, size, draw = np.array(p, float), np.array(size, float), random.Random(seed).random
    order = np.argsort(-size, kind="stable")
    order = order[(p[order] > NEAR) & (p[order] < 1 - NEAR)]
    for place, i in enumerate(order):
        rest = order[place + 1 :]
        while NEAR < p[i] < 1 - NEAR:
            rest = rest[(p[rest] > NEAR) & (p[rest] < 1 - NEAR)]
            x = size[rest]
            if not len(rest) or (x[0] == x[-1] and x[0] != size[i]):
                # No shorter ones that balance both sums: it stays open.
                break
            if x[0] == x[-1]:
                u = np.full(len(rest), -1 / len(rest))
            else:
                # Of the lines that keep both sums the one that moves the others least.
                mean = x.mean()
                u = -1 / len(rest) - (size[i] - mean) * (x - mean) / ((x - mean) ** 2).sum()
            at, v = np.append(rest, i), np.append(u, 1.0)
            now = p[at]
            with np.errstate(divide="ignore"):
                up, down = np.where(v > 0, (1 - now) / v, np.where(v < 0, -now / v, np.inf)).min(), np.where(v > 0, now / v, np.where(v < 0, (now - 1) / v, np.inf)).min()
            t = up if draw() * (up + down) < down else -down
            now = np.clip(now + t * v, 0, 1)
            p[at] = np.where(now <= NEAR, 0, np.where(now >= 1 - NEAR, 1, now))
    return p.tolist()


def _landing(p: list[float], size: list[float]) -> list[float]:
    """Settles the last fractions: the choice whose tokens come nearest to what is due."""
    p = list(p)
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    due = sum(p[i] * size[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(due - sum(size[i] for b, i in enumerate(left) if m >> b & 1)), m))
    for b, i in enumerate(left):
        p[i] = float(best >> b & 1)
    return p


def _hashable(df: DataFrame, name: str) -> Column:
    """What of a column a hash can be made of: maps go as text."""
    kind = df.schema[name].dataType.simpleString()
    return F.to_json(F.struct(quoted(name))) if "map<" in kind or "variant" in kind else quoted(name)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n: equal deals numbered from 0. Numbers are dealt in SALTS parts, so many equal rows meet in no one task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    counts = salted.groupBy("deal", "salt").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("deal").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", F.coalesce(before, F.lit(0))).where("start > 0").select("deal", "salt", "start")
    here = F.row_number().over(Window.partitionBy("deal", "salt").orderBy("at")) - 1
    return salted.withColumn("here", here).join(starts, ["deal", "salt"], "left").withColumn("n", F.col("here") + F.coalesce("start", F.lit(0))).drop("salt", "here", "start")


def mix_sources(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to most), taken = copies * size, and the carried columns.

    size: a document's tokens, by default its words (null text: 0). Null sources form one source, the last. Documents
    without tokens count as documents and take nothing. Repeated rows are documents of their own. If all sizes are 0, so
    are targets and copies. Blocks are dealt, and their steps drawn, by hashes of doc_id, size and carried columns, and
    equal rows by their number, so reruns agree. Extra columns are ignored unless carried; carried ones may be of any type,
    and one that bears the name of a result gives way to it. An empty table gives an empty one.
    """
    if size is None:
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    results = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    carry = [c for c in carry if c.lower() not in results]
    deal = F.xxhash64("doc_id", size.cast("long"), *(_hashable(docs, c) for c in carry))
    held = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").alias("id"), F.col("source").alias("source"), size.cast("long").alias("size"), deal.alias("deal"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(carry)))
    rows = store(held)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = store(targets.withColumn("rate", F.least(F.lit(float(most)), rate)).withColumnRenamed("source", "_source"))
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    part = F.col("rate") - F.floor(F.col("rate") + NEAR)
    # Only numbers fly: a row's place, size and deal. What is carried meets the copies at the end.
    now = _numbered(rows.select("at", "source", "size", "deal")).join(targets, same_source)
    now = now.select("at", "source", "size", "deal", "n", F.when(part > NEAR, part).otherwise(F.lit(0.0)).alias("p"), F.col("source_docs").alias("of"))
    names = now.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)

    def run(last: bool):
        def settle(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("deal", "ascending"), ("n", "ascending")]).select(names)
            sizes = [float(x) for x in rows["size"].to_pylist()]
            seed = zlib.crc32(np.array([rows["deal"].to_pylist(), rows["n"].to_pylist()], np.int64).tobytes())
            p = _flight(rows["p"].to_pylist(), sizes, seed)
            return rows.set_column(names.index("p"), "p", pa.array(_landing(p, sizes) if last else p, pa.float64()))

        return settle

    ready, level = [], 0
    while True:
        blocks = F.ceil(F.col("of") / block)
        most_blocks = (now.agg(F.max(blocks)).first()[0] or 1) if level else (targets.agg(F.max(F.ceil(F.col("source_docs") / block))).first()[0] or 1)
        last = most_blocks <= 1
        dealt = now.withColumn("block", F.pmod(F.xxhash64("deal", "n", F.lit(level)), F.greatest(blocks, F.lit(1))))
        out = store(dealt.groupBy("source", "block").applyInArrow(run(last), schema))
        if last:
            ready.append(out)
            break
        ready.append(out.where("p = 0 OR p = 1"))
        now = out.where("p > 0 AND p < 1")
        left = store(now.groupBy("source").agg(F.count("*").alias("_of")).withColumnRenamed("source", "_source"))
        now = now.drop("of").join(left, same_source).drop("_source").withColumnRenamed("_of", "of").select(*names)
        level += 1
    done = ready[0]
    for more in ready[1:]:
        done = done.unionByName(more)
    sure = F.floor(F.col("rate") + NEAR).cast("int")
    ends = done.select("at", F.col("p").cast("int").alias("more"))
    copies = (F.col("sure") + F.col("more")).cast("int")
    mixed = rows.join(ends, "at").join(targets.withColumn("sure", sure), same_source)
    return mixed.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(f"c{i}" for i in range(len(carry)))).toDF(*results, *carry)
