"""Benchmark scenarios: a JSON list of searches with what they should find; timed, judged, reported."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import observe
from siftwell.plans.search import Engine, SearchSpec
from siftwell.sources.corpus import tree_files

SCHEMA = (
    "name string, path string, symbol string, language string, expected struct<path: string, line: long, top_n: long>, "
    "enable_index boolean, enable_rga boolean, max_matches long, timeout_secs long"
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(SCHEMA).json(path)


def run_scenarios(spark: SparkSession, scenarios: DataFrame, root: str, iterations: int = 3) -> DataFrame:
    """Runs each scenario's search some times and returns runs (name, ms, ok). Scenarios are few; searches run one by one,
    since it is their latency that is asked for."""
    runs, hits = [], []
    rows = scenarios.collect()
    for s in rows:
        files = tree_files(spark, os.path.join(root, s.path or ""))
        spec = SearchSpec(s.symbol, language=s.language, use_index=bool(s.enable_index), use_pages=bool(s.enable_rga), max_matches=s.max_matches or 20, timeout_secs=s.timeout_secs or 60)
        for i in range(max(1, iterations)):
            began = time.monotonic()
            summary = Engine(spark, files).search(spec)
            runs.append((s.name, i, (time.monotonic() - began) * 1000))
            hits += [(f"{s.name}#{i}", t["path"], t["line_no"], t["rank"]) for t in summary.top_hits]
    expected = [(f"{s.name}#{i}", s.expected and s.expected.path, s.expected and s.expected.line, s.expected and s.expected.top_n) for s in rows for i in range(max(1, iterations))]
    met = observe.expectation_met(spark.createDataFrame(hits, "name string, path string, line_no long, rank long"), spark.createDataFrame(expected, "name string, path string, line_no long, top_n long"))
    timed = spark.createDataFrame(runs, "name string, i int, ms double").withColumn("run", F.concat("name", F.lit("#"), F.col("i").cast("string")))
    return timed.join(met.withColumnRenamed("name", "run"), "run").select("name", "ms", "ok")


def append_report(report: DataFrame, path: str, now: float | None = None) -> None:
    """One JSON line for a report; a folder gets a file of the usual name. The row without a name holds the totals."""
    rows = [r.asDict() for r in report.collect()]
    record = {"timestamp": now if now is not None else time.time(), "totals": next((r for r in rows if r["name"] is None), None), "scenarios": [r for r in rows if r["name"] is not None]}
    if os.path.isdir(path):
        path = os.path.join(path, "benchmark-summary.jsonl")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record) + "\n")
