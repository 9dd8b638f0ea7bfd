"""Connected components of a link table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import drop, store


SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node that has a link; label is the component's smallest node.

    links: (a, b), any order. A round takes each node's smallest label among its neighbours, then the label of that
    label, so a chain of n nodes needs about log n rounds and a star two. Labels stay tables; only the number of changed
    labels reaches the driver.
    """
    both = store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # Many nodes may have one label: they are dealt over SALTS parts, to each of which the label's own label is copied.
        jump = labels.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("beyond"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = low.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        step = store(dealt.join(jump, ["label", "salt"], "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was"))
        changed = step.where("label <> was").limit(1).count()
        drop(labels)
        labels = step
        if not changed:
            drop(both)
            out = labels.select("node", "label")
            out._stage_path = labels._stage_path
            return out
