"""Tables in the folder all executors share, and small helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
"""What separates words: the six ASCII white space characters."""
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; the warehouse where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages").rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and a lost executor costs no work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: together its key. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


BATCH = 1000
"""Rows of a batch that Spark hands to Python, where the session has not set its own: texts may be long."""


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, keep: list[str], fields: dict[str, str], start: Callable[[], Callable[[list], list]], text: str = "text", slab: int = 250, flat: bool = False) -> DataFrame:
    """The kept columns of df, untouched, and new fields (name: type) made from a text column.

    start() runs once in each task and returns a function from a list of texts to one list for each field; with flat it
    gets an Arrow array and returns Arrow arrays. Texts pass in slabs, so that memory follows the slab and not the batch.
    Nulls arrive as None. A kept column that bears the name of a new field gives way to it: the field is returned.

    A session that has left Arrow's batch size at Spark's default gets BATCH rows a batch from here on.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    made_names = {f.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in made_names]
    # Columns go by place while they are with Python, so no name can clash there.
    held = df.select(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), *([] if text in keep else [quoted(text).alias("t")]))
    source = keep.index(text) if text in keep else len(keep)
    names = [*(f"k{i}" for i in range(len(keep))), *(f"f{i}" for i in range(len(fields)))]
    kinds = [*(t for _, t in held.dtypes[: len(keep)]), *fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            for batch in slabs(whole, source, slab):
                made = make(batch.column(source) if flat else batch.column(source).to_pylist())
                arrays = [x if flat else pa.array(x, ARROW[t]) for x, t in zip(made, fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=names)

    return held.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True))).toDF(*keep, *fields)


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones renamed by place, and a function that gives a result its names back: no
    column of a caller can clash with one that a stage makes."""
    cols = docs.columns
    inner = [c if c in needed else f"col_{i}" for i, c in enumerate(cols)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*cols)


SLAB_BYTES = 1 << 20
"""Bytes of text that are worked on at once; a longer text is a slab of its own."""


def slabs(batch: pa.RecordBatch, source: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and about SLAB_BYTES of text."""
    column = batch.column(source)
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= rows or held + size > SLAB_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


class WordHasher:
    """64-bit hashes of words; equal words are hashed once while the cache holds them."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower and bytes.split know ASCII alone, which is what is asked for."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; with fewer words the whole sequence is the one run, without words there is none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
    return out
