"""The pipeline stage by stage: columns, effects, reruns."""

from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm.mixing import mix_sources
from siftwell.llm.secrets import scan_secrets
from siftwell.llm.shared import store


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "x password = hunter2hunter2", "en", "s", 27), (-2, "x password = hunter2hunter2", "en", "s", 27)], docs.schema)
    now = store(docs.union(odd))
    counts = [now.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = store(stage(spark, now, sf))
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        now = out
        if i == 1:
            assert out.where("doc_id = -2").count() <= 1
        if i == 2:
            assert not scan_secrets(out, ["doc_id"]).where("size(starts) > 0").collect()
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4] > 0
    assert set(now.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_leave_extra_columns_alone(spark, sf):
    """Columns that bear the names of what stages and operators make inside, arrays and maps, and many equal rows."""
    names = ["size", "source_size", "target", "taken", "copies", "copy", "p", "n", "at", "deal", "score", "kept", "k1", "k2", "_k1", "_t1", "_packed", "_kinds", "sid", "component", "ids", "blob", "x", "t", "f0", "c0", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    same = spark.createDataFrame([(10**6, "some words that stand in every one of these rows, twice or more", "en", "src1", 63)], docs.schema)
    docs = docs.union(same.select("*", F.explode(F.sequence(F.lit(1), F.lit(1500)))).drop("col"))
    extra = {c: F.concat(F.lit(c), F.lit("="), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names}
    docs = store(docs.select("*", *(v.alias(c) for c, v in extra.items()), F.array("doc_id").alias("list"), F.create_map(F.lit("k"), "doc_id").alias("map")))
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = store(stage(spark, now, sf))
        if i < 4:
            assert now.dtypes == docs.dtypes and now.count() > 0
            for r in now.collect():
                assert [r[c] for c in names] == [f"{c}={r.doc_id}" for c in names] and r["list"] == [r.doc_id] and r["map"] == {"k": r.doc_id}
    assert now.count() > 0


def test_mix_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("_")
    other = spark.createDataFrame([(i, "w " * (i % 50 + 1), "t") for i in range(2, 3000)], rows.schema)
    docs = rows.union(other)
    first, again = ([tuple(r) for r in mix_sources(d).groupBy("doc_id", "copies").count().orderBy("doc_id", "copies").collect()] for d in (docs, docs.repartition(7)))
    assert first == again
    taken = {r.source: (r.taken, r.target) for r in mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(taken[s][0] - taken[s][1]) <= 60 for s in taken)


def test_stage_values(spark, sf):
    """Each stage against a plain version on the same rows."""
    import hashlib
    import re
    from fractions import Fraction

    from test_jaccard import brute
    from tokenizers import Tokenizer

    from siftwell.llm import secrets
    from siftwell.llm.quality import KEEP, quality_scores
    from siftwell.llm.queries import tokenizer_path

    docs = store(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    good = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf).collect()}
    assert good == {r.doc_id for r in quality_scores(docs, labels).where(F.col("score") >= KEEP).collect()} and 0 < len(good) < len(rows)

    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == {c for _, _, c in brute([(i, r.text) for i, r in rows.items()], 5, Fraction(4, 5))}

    for r in corpus_pipeline.redact_secrets(spark, docs, sf).collect():
        text, spans = rows[r.doc_id].text or "", []
        for pattern, group, least in secrets.RULES.values():
            spans += [(m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        marks = bytearray(len(text) + 1)
        for a, b in spans:
            marks[a:b] = b"\1" * (b - a)
        starts = {min(a for a, b in spans if a <= i < b) for i in range(len(text)) if marks[i]}
        heads = {i for i in starts if i == 0 or not marks[i - 1] or any(b == i for a, b in spans) and not any(a < i < b for a, b in spans)}
        assert r.text == "".join("[secret]" if i in heads else "" if marks[i] else c for i, c in enumerate(text)), r.doc_id
        assert r.n_chars == len(r.text)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    for r in corpus_pipeline.tokens(spark, docs, sf).collect():
        ids = tokenizer.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_is_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf))
    found = [sorted(map(tuple, d.collect())) for d in (corpus_pipeline.run(spark, sf), docs)]
    assert found[0] == found[1] and len(found[0]) > 50
