"""Benchmark reports, latency statistics and metrics from run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def throughput(mean_ms: Column) -> Column:
    return F.when(mean_ms > 0, 1000 / mean_ms).otherwise(0.0)


def exclusive_p95(values: Column) -> Column:
    """The 95th of 100 by the exclusive rule (place (n + 1) * 0.95, interpolated) from 20 values on, else the largest."""
    s = F.sort_array(values)
    n = F.size(s)
    place = (n + 1) * 0.95
    low = F.floor(place).cast("int")
    a = F.get(s, low - 1)
    b = F.get(s, F.least(low, n - 1))
    return F.when(n < 20, F.array_max(values)).otherwise(a + (b - a) * (place - low))


def scenario_report(runs: DataFrame) -> DataFrame:
    """One row for each name, and one with a null name for all: runs(name, ms, ok). Both levels come from one rollup."""
    mean = F.avg("ms")
    return runs.rollup("name").agg(
        F.count("*").alias("iterations"), F.round(mean, 6).alias("mean_ms"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.round(throughput(mean), 6).alias("qps"),
    )


NEAR = ((100_000, 0.9495, 0.9505), (1_000, 0.94, 0.96), (0, 0.0, 1.0))
"""From so many runs on, between these shares the two values lie that the exclusive rule needs."""


def latency_summary(runs: DataFrame) -> DataFrame:
    """(name, n, mean_ms, min_ms, max_ms, p95_ms), the last by the exclusive rule.

    Two values of each name decide it. A first pass bounds where they are, a second counts what lies below and the values in
    between, so of a name with very many runs only a small part is sorted, and equal values are one row.
    """
    shares = [x for _, *pair in NEAR for x in pair]
    ends = F.percentile_approx("ms", shares, 10_000)
    stats = runs.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), ends.alias("_e"))
    low, high = F.lit(None), F.lit(None)
    for i, (least, _, _) in reversed(list(enumerate(NEAR))):
        low, high = (F.when(F.col("n") >= least, F.get("_e", F.lit(2 * i + j))).otherwise(x) for j, x in ((0, low), (1, high)))
    stats = stats.withColumns({"_low": low, "_high": high}).drop("_e")
    held = runs.select("name", "ms").join(stats.select(F.col("name").alias("_name"), "_low", "_high"), F.col("name").eqNullSafe(F.col("_name"))).where("ms <= _high")
    counted = held.groupBy("name", F.when(F.col("ms") >= F.col("_low"), F.col("ms")).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("name").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).where("value IS NOT NULL").join(stats.select(F.col("name").alias("_name"), "n"), F.col("name").eqNullSafe(F.col("_name")))
    place = (F.col("n") + 1) * 0.95
    first = F.floor(place)

    def at(k: Column) -> Column:
        return F.min(F.when(F.col("upto") >= k, F.col("value")))

    found = placed.groupBy(F.col("name").alias("_name")).agg(at(first).alias("a"), at(F.least(first + 1, F.col("n"))).alias("b"), F.max(place - first).alias("part"))
    p95 = F.when(F.col("n") < 20, F.col("max_ms")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    joined = stats.join(found, F.col("name").eqNullSafe(F.col("_name")), "left")
    return joined.select("name", "n", "mean_ms", "min_ms", "max_ms", F.round(p95, 6).alias("p95_ms"))


def gap(report: DataFrame, plain: str, ours: str, most_ms: float = 6.0) -> DataFrame:
    """(gap_ms, passes): how much slower one scenario of a report is on average than another, and whether that is allowed."""
    mean = {n: F.max(F.when(F.col("name") == n, F.col("mean_ms"))) for n in (plain, ours)}
    found = report.agg((mean[ours] - mean[plain]).alias("gap_ms"))
    return found.select(F.round("gap_ms", 6).alias("gap_ms"), (F.col("gap_ms") <= most_ms).alias("passes"))


def gate(report: DataFrame, max_mean_ms: float = 20.0, min_success: float = 0.99) -> DataFrame:
    """Scenarios that are too slow or too rarely right."""
    slow, wrong = F.col("mean_ms") > max_mean_ms, F.col("success_rate") < min_success
    return report.where("name IS NOT NULL").select("name", slow.alias("too_slow"), wrong.alias("too_wrong"), (~slow & ~wrong).alias("passes"))


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def stage_summary(runs: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, mean_ms, max_ms) from columns of stage latencies."""
    long = runs.unpivot([], stages, "stage", "ms")
    return long.where("ms IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"))


def counters(events: DataFrame, label: str) -> DataFrame:
    return events.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("total"))


def histogram(events: DataFrame, label: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(label, le, cumulative): how many values are at most each bound; zero values are skipped. One aggregation, no window."""
    held = events.where(F.col(value) > 0).groupBy(F.col(label).alias("label"))
    counted = held.agg(*(F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("all"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counted.select("label", F.explode(rows).alias("r")).select("label", F.col("r.le").alias("le"), F.col("r.n").alias("cumulative"))


def exposition(events: DataFrame, label: str, value: str, counter: str, hist: str) -> DataFrame:
    """(line_no, line): counters and histograms in the text format that monitoring scrapes, in order, with their help."""

    def named(name: str, *more: Column) -> Column:
        return F.concat(F.lit(f"{name}{{label=\""), F.col("label"), *more, F.lit("\"} "))

    def head(at: int, name: str, kind: str, text: str) -> list[tuple]:
        return [(at, "", 0, f"# HELP {name} {text}"), (at, "", 1, f"# TYPE {name} {kind}")]

    heads = events.sparkSession.createDataFrame([*head(0, counter, "counter", "Events by label."), *head(1, hist, "histogram", "Values by label.")], "part int, label string, at int, line string")
    counted = counters(events, label).select(F.lit(0).alias("part"), "label", F.lit(2).alias("at"), F.concat(named(counter), F.col("total").cast("string")).alias("line"))
    bounds = F.array(*(F.lit(str(b)) for b in BUCKETS), F.lit("+Inf"))
    buckets = histogram(events, label, value).select(F.lit(1).alias("part"), "label", (F.array_position(bounds, F.col("le")) + 2).cast("int").alias("at"), F.concat(named(hist + "_bucket", F.lit("\",le=\""), F.col("le")), F.col("cumulative").cast("string")).alias("line"))
    sums = events.where(F.col(value) > 0).groupBy(F.col(label).alias("label")).agg(F.round(F.sum(value), 3).cast("decimal(30,3)").alias("s"), F.count("*").alias("n"))
    rest = F.array(F.concat(named(hist + "_sum"), F.col("s").cast("string")), F.concat(named(hist + "_count"), F.col("n").cast("string")))
    tails = sums.select(F.lit(1).alias("part"), "label", F.posexplode(rest).alias("at", "line")).withColumn("at", F.col("at") + 100)
    every = heads.union(counted).union(buckets).union(tails.select("part", "label", "at", "line"))
    # A few lines for each label meet here.
    return every.select(F.row_number().over(Window.orderBy("part", "label", "at")).cast("long").alias("line_no"), "line")


def expectation_met(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok): expected(name, path, line_no, top_n) against ranked hits(name, path, line_no, rank). A path matches whole
    or as the end of one at a directory's start; without a path any hit does; without a line any line."""
    h, e = hits.alias("h"), expected.alias("e")
    path = F.col("e.path").isNull() | (F.col("h.path") == F.col("e.path")) | F.endswith("h.path", F.concat(F.lit("/"), F.col("e.path")))
    line = F.col("e.line_no").isNull() | (F.col("h.line_no") == F.col("e.line_no"))
    rank = F.col("h.rank") <= F.coalesce(F.col("e.top_n"), F.when(F.col("e.path").isNull(), F.lit(1 << 40)).otherwise(F.lit(1)))
    joined = e.join(h, F.col("h.name") == F.col("e.name"), "left")
    return joined.groupBy(F.col("e.name").alias("name")).agg(F.max(F.coalesce(path & line & rank & F.col("h.path").isNotNull(), F.lit(False))).alias("ok"))
