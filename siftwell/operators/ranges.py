"""Points in ranges of lines, joined by bins: an equality join whose rows follow the ranges' lengths, not their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 64
"""Lines of a bin."""


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def containing(points: DataFrame, ranges: DataFrame, at: str = "line_no", start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """Each point (path, at) with each range (path, start, end) that holds it. A range is copied to its bins; the columns of
    both but path must differ."""
    binned = ranges.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))
    met = points.withColumn("_bin", _bin(F.col(at), width)).join(binned, ["path", "_bin"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def merged(points: DataFrame, before: int, after: int, at: str = "line_no") -> DataFrame:
    """(path, start, end, hits): the ranges of lines around points, those that touch or overlap as one."""
    order = Window.partitionBy("path").orderBy("_s", "_e")
    ranges = points.select("path", F.greatest(F.lit(1), F.col(at) - before).alias("_s"), (F.col(at) + after).alias("_e"))
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("_new", (F.coalesce(reach, F.lit(-1)) + 1 < F.col("_s")).cast("int"))
    numbered = fresh.withColumn("_n", F.sum("_new").over(order))
    return numbered.groupBy("path", "_n").agg(F.min("_s").cast("long").alias("start"), F.max("_e").cast("long").alias("end"), F.count("*").alias("hits")).drop("_n")


def contexts(points: DataFrame, lines: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """(path, start, end, hits, text): the lines around all hits, each line once; end stops at the file's last line."""
    held = containing(lines.select("path", "line_no", "line"), merged(points, before, after))
    text = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    found = held.groupBy("path", "start", "hits").agg(F.max("line_no").alias("end"), text.alias("_t"))
    return found.select("path", "start", "end", "hits", F.array_join(F.transform("_t", lambda x: x["line"]), "\n").alias("text"))
