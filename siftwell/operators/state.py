"""Hints that outlive a search: paths by symbol, popular directories; and their eviction."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_SYMBOL, SYMBOLS, DIRECTORIES, COUNTED = 10, 500, 200, 20


def observe_directories(ranked: DataFrame, stored: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(dir, score): stored scores plus one for each of the best hits in the directory."""
    new = ranked.where(F.col("rank") <= counted).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''").groupBy("dir").agg(F.count("*").alias("score"))
    return stored.select("dir", "score").union(new).groupBy("dir").agg(F.sum("score").cast("long").alias("score"))


def observe_symbol(ranked: DataFrame, stored: DataFrame, symbol: str, most: int = PER_SYMBOL) -> DataFrame:
    """(symbol, path, pos): a symbol's stored paths, then those of its best hits, each once, the first `most`."""
    old = stored.where(F.col("symbol") == symbol).select("path", F.lit(0).alias("new"), "pos")
    new = ranked.where(F.col("rank") <= most).select("path", F.lit(1).alias("new"), F.col("rank").alias("pos"))
    first = old.union(new).groupBy("path").agg(F.min(F.struct("new", "pos")).alias("at")).orderBy("at.new", "at.pos", "path").limit(most)
    return first.select(F.lit(symbol).alias("symbol"), "path", F.row_number().over(Window.orderBy("at.new", "at.pos", "path")).cast("long").alias("pos"))


def live_hints(hints: DataFrame, files: DataFrame, symbol: str) -> DataFrame:
    """A symbol's stored paths that still exist and are not hidden: (path, pos)."""
    held = hints.where(F.col("symbol") == symbol).where(~F.col("path").rlike(r"(^|/)\."))
    return held.join(files.select("path"), "path", "left_semi").select("path", "pos")


def evict_directories(scores: DataFrame, most: int = DIRECTORIES) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "dir").limit(most)


def evict_symbols(symbols: DataFrame, most: int = SYMBOLS) -> DataFrame:
    """The symbols used last."""
    return symbols.orderBy(F.col("last_seen").desc(), "symbol").limit(most)


@dataclass
class State:
    """The state of one root on the driver: bounded by the limits above, saved as one JSON file that is replaced whole."""

    symbol_hits: dict[str, list[str]] = field(default_factory=dict)
    directory_scores: dict[str, int] = field(default_factory=dict)
    last_seen: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> State:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            return cls({k: list(v) for k, v in raw["symbol_hits"].items()}, dict(raw["directory_scores"]), dict(raw.get("last_seen", {})))
        except FileNotFoundError:
            return cls()
        except (ValueError, KeyError, AttributeError, OSError) as e:
            return cls(warnings=[f"state ignored: {e}"])

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump({"symbol_hits": self.symbol_hits, "directory_scores": self.directory_scores, "last_seen": self.last_seen}, f, indent=2, sort_keys=True)
        os.replace(f"{path}.tmp", path)

    def observe(self, symbol: str, paths: list[str], now: float) -> None:
        seen = dict.fromkeys([*self.symbol_hits.get(symbol, []), *paths[:PER_SYMBOL]])
        self.symbol_hits[symbol] = list(seen)[:PER_SYMBOL]
        self.last_seen[symbol] = now
        for p in paths[:COUNTED]:
            if d := os.path.dirname(p):
                self.directory_scores[d] = self.directory_scores.get(d, 0) + 1
        for s in sorted(self.symbol_hits, key=lambda s: (-self.last_seen.get(s, 0.0), s))[SYMBOLS:]:
            del self.symbol_hits[s]
            self.last_seen.pop(s, None)
        kept = sorted(self.directory_scores.items(), key=lambda kv: (-kv[1], kv[0]))[:DIRECTORIES]
        self.directory_scores = dict(kept)
