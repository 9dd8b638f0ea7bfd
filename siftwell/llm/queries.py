"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, oracle, secrets
from siftwell.llm.annulus import centroid_clusters
from siftwell.llm.fingerprints import fingerprint_edits
from siftwell.llm.html import extract_html
from siftwell.llm.jaccard import jaccard_components
from siftwell.llm.licenses import scan_licenses
from siftwell.llm.minhash import minhash_components
from siftwell.llm.mixing import mix_sources
from siftwell.llm.quality import quality_scores
from siftwell.llm.repeats import remove_repeats
from siftwell.llm.resampling import resample
from siftwell.llm.rules import quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the vocabulary file of the box lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of at least 0.9."""
    out = jaccard_components(_table(spark, sf_dir), k=3, likeness=Fraction(9, 10))
    return out.select("doc_id", "n_shingles", "component_id", "set_docs")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that occur again, judged on the input."""
    out = remove_repeats(_table(spark, sf_dir), ["doc_id"])
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return out.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighted 5, 2, 1 in turn."""
    return mix_sources(_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(_table(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return scan_licenses(_table(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir), tokenizer_path(), ["doc_id"]))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digests(secrets.scan_secrets(_table(spark, sf_dir), ["doc_id"]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside the held-out fold."""
    return quality_scores(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_html(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and log-likelihood verdicts of all documents; the trusted target is what labels mark as good."""
    labels = _table(spark, sf_dir, "labels")
    return quality_rules(_table(spark, sf_dir), labels.where("quality = 1"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-component vectors in 40 clusters after 5 rounds."""
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents towards the benchmark's texts, and the ranks of the quarter that is drawn."""
    return resample(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have a Jaccard similarity of at least 0.8."""
    return minhash_components(_table(spark, sf_dir), k=2)


_ALL = (
    op1_ngram_jaccard_join,
    op2_suffix_array_dedup,
    op3_source_mixing,
    op4_fingerprints,
    op5_license_scan,
    op6_bpe,
    op7_secret_scan,
    op8_quality_classifier,
    op9_html_extraction,
    op10_quality_rules,
    op11_centroid_clustering,
    op12_importance_resampling,
    op13_minhash_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracle.JACCARD,
    "op2_suffix_array_dedup": oracle.REPEATS,
    "op5_license_scan": oracle.LICENSES,
    "op11_centroid_clustering": oracle.CLUSTERS,
    "op12_importance_resampling": oracle.RESAMPLE,
    "op13_minhash_dedup": oracle.MINHASH,
}
