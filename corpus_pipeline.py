"""A training-data pipeline over documents: quality, near duplicates, secrets, mix, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what the next one gets as docs. Between
stages the rows are written as Parquet to the folder all executors share and read again.

Null and empty texts: the classifier scores them as empty texts; what it keeps passes on. All stages but the last return
the columns of documents as they came, extra ones included.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, secrets
from siftwell.llm.jaccard import jaccard_components
from siftwell.llm.mixing import mix_sources
from siftwell.llm.quality import KEEP, fit, held_out, measure, score_texts
from siftwell.llm.queries import tokenizer_path
from siftwell.llm.shared import WORD, apart, drop, store, text_keys


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of documents outside the held-out fold."""
    docs, named = apart(docs, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    measured = store(measure(docs.join(known.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), ["doc_id"]))
    model = fit(measured.join(known, "doc_id"))
    drop(measured)
    return named(score_texts(model, docs, docs.columns).where(F.col("score") >= KEEP))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more.

    The one kept has the component's smallest doc_id; of rows that share it, one with the smallest text hashes. Documents
    without words are linked with nothing and stay.
    """
    docs, named = apart(docs, "doc_id", "text")
    found = jaccard_components(docs, k=5, likeness=Fraction(4, 5))
    # A component's kept row: its smallest doc_id (nulls last), then the smallest text hashes.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    with_words = found.where("n_shingles > 0")
    heads = with_words.groupBy("component").agg(F.min(first).alias("h")).select("h.doc_id", "h.k1", "h.k2").distinct()
    bare = found.where("n_shingles = 0").select("doc_id", "k1", "k2").distinct()
    k1, k2 = text_keys(F.col("text"))
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    kept = heads.union(bare).withColumnsRenamed({"doc_id": "_id", "k1": "_h1", "k2": "_h2"})
    on = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_k1"] == kept["_h1"]) & (keyed["_k2"] == kept["_h2"])
    out = keyed.join(kept, on, "left_semi")
    if with_words.groupBy("doc_id", "k1", "k2").count().where("count > 1").limit(1).count():
        # Rows that repeat whole: of those with words one stays.
        bare_row = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) == 0
        out = out.where(bare_row).union(out.where(~bare_row).dropDuplicates(["doc_id", "_k1", "_k2"]))
    return named(out)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 times."""
    docs, named = apart(docs, "doc_id", "source", "text")
    mixed = mix_sources(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")])
    return named(mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each document."""
    return bpe.digests(bpe.encode_decode(docs, tokenizer_path(), ["doc_id"]))


STAGES = [
    ("quality classifier", keep_good),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        done = store(stage(spark, docs, sf_dir))
        if i:
            drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
