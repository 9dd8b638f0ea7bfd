"""The streaming state against searches one after the other."""

import json

from pyspark.sql import functions as F

from siftwell.operators.state import State
from siftwell.streaming import state as streams

SCHEMA = "symbol string, path string, ts timestamp"


def log(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"symbol": s, "path": p, "ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"}) for s, p, t in rows) + "\n")


def test_replay_equals_searches(spark, tmp_path):
    rows = [(f"s{i % 5}", f"d{i % 3}/f{i * 7 % 23}.rs", i) for i in range(200)] + [("top", "no_folder.rs", 201)]
    wanted = State()
    for s, p, t in rows:
        wanted.observe(s, [p], float(t))
    (tmp_path / "log").mkdir()
    found = spark.readStream.schema(SCHEMA).json(str(tmp_path / "log"))
    for part, (a, b) in enumerate(((0, 90), (90, 91), (91, 201))):
        log(tmp_path / "log", f"{part}.json", rows[a:b][::-1])
        for name, states in (("symbols", streams.symbol_states(found)), ("dirs", streams.directory_states(found))):
            q = streams.follow(states, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
            q.awaitTermination()
            assert q.exception() is None
    now = {r.symbol: r.paths for r in streams.symbols_now(spark, str(tmp_path / "symbols")).collect()}
    assert now == wanted.symbol_hits
    assert {r.dir: r.score for r in streams.directories_now(spark, str(tmp_path / "dirs")).collect()} == wanted.directory_scores
    assert [r.symbol for r in streams.symbols_now(spark, str(tmp_path / "symbols"), 1).collect()] == ["top"]
    assert streams.directories_now(spark, str(tmp_path / "dirs"), 2).count() == 2


def test_symbols_expire_by_event_time(spark, tmp_path):
    (tmp_path / "log").mkdir()
    found = spark.readStream.schema(SCHEMA).json(str(tmp_path / "log"))
    states = lambda: streams.symbol_states(found, idle="60", late="1 second")
    for part, rows in enumerate(([("old", "a/x.rs", 0), ("new", "a/y.rs", 5)], [("new", "a/z.rs", 50)], [("new", "b/w.rs", 100)], [("new", "b/v.rs", 101)])):
        log(tmp_path / "log", f"{part}.json", rows)
        q = streams.follow(states(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
    now = {r.symbol: r.paths for r in streams.symbols_now(spark, str(tmp_path / "out")).collect()}
    assert now == {"new": ["a/y.rs", "a/z.rs", "b/w.rs", "b/v.rs"]}
    gone = spark.read.parquet(str(tmp_path / "out")).where(F.col("expired")).collect()
    assert [r.symbol for r in gone] == ["old"]
