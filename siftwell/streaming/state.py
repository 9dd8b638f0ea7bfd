"""The state of searches as keyed streaming state: what a stream of found paths leaves for each symbol and directory.

A symbol's state is its first paths by time and when it was seen last: a bounded row, whatever passes. A replay of the log
gives what a search after the other does. Symbols not seen for some time expire by event time. Each micro-batch writes its
changed rows to a folder of its own, so a batch that is run again replaces them, and a snapshot reads the last row of each key
and evicts as the batch operators do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.state import DIRECTORIES, PER_SYMBOL, SYMBOLS, evict_directories, evict_symbols

SYMBOL_STATE = "symbol string, paths array<string>, last_seen double, expired boolean"


def symbol_states(found: DataFrame, most: int = PER_SYMBOL, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(symbol, paths, last_seen, expired) of the symbols that a stream found (symbol, path, ts) touches, in update mode.

    paths: the first `most` distinct ones by time, of equal times by path. With idle, an interval in seconds, a symbol that is
    not seen for so long by the watermark expires: its row comes once more, without paths.
    """
    seconds = float(idle) if idle else None
    held = found.select("symbol", "path", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"))
    held = held.withWatermark("ts", late) if idle else held

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[2]
            state.remove()
            yield pd.DataFrame({"symbol": [key[0]], "paths": [[]], "last_seen": [last], "expired": [True]})
            return
        paths, times, last = state.get if state.exists else ([], [], float("-inf"))
        first = dict(zip(paths, times, strict=True))
        for part in rows:
            last = max(last, float(part["at"].max()))
            for path, at in part.groupby("path")["at"].min().items():
                first[path] = min(at, first.get(path, at))
            # What falls out here can only come back with an earlier time.
            first = dict(sorted(first.items(), key=lambda x: (x[1], x[0]))[:most])
        state.update((list(first), [float(t) for t in first.values()], last))
        if seconds is not None:
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"symbol": [key[0]], "paths": [list(first)], "last_seen": [last], "expired": [False]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return held.groupBy("symbol").applyInPandasWithState(update, SYMBOL_STATE, "paths array<string>, times array<double>, last double", "update", timeout)


def directory_states(found: DataFrame) -> DataFrame:
    """(dir, score): how many paths were found in each directory so far."""
    return found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''").groupBy("dir").agg(F.count("*").alias("score"))


def follow(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes changed rows of a state, batch by batch, until the stream's present end."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, folder: str, key: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def symbols_now(spark: SparkSession, folder: str, most: int = SYMBOLS) -> DataFrame:
    """(symbol, paths, last_seen) of the symbols seen last."""
    return evict_symbols(_last(spark, folder, "symbol").where("NOT expired").drop("expired"), most)


def directories_now(spark: SparkSession, folder: str, most: int = DIRECTORIES) -> DataFrame:
    return evict_directories(_last(spark, folder, "dir"), most)
