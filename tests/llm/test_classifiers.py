"""Held-out accuracy, and what must not matter to a score."""

import pytest
from harness import compare, data_dir
from pyspark.sql import functions as F

from loamstone.llm import toxicity
from loamstone.llm import queries as llm


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(data_dir("0.1") + "/labels.parquet")


def accuracy(df, label):
    r = df.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()
    return r.a


def test_quality_held_out(spark, labels):
    got = llm.op7_quality_classifier(spark, data_dir("0.1")).join(labels, "doc_id").where("held_out").persist()
    assert accuracy(got, "quality") > 0.97
    assert got.agg(F.min("score"), F.max("score")).first()[0] >= 0


def test_language_held_out(spark):
    docs = spark.read.parquet(data_dir("0.1") + "/documents.parquet").select("doc_id", "lang")
    got = llm.op8_language_id(spark, data_dir("0.1")).join(docs, "doc_id").where("held_out").persist()
    assert got.where("lang = lang_pred").count() > 0.97 * got.count()
    # Rejection is calibrated: what is accepted is right more often than what is not.
    right = got.agg(F.avg(F.when(~F.col("rejected"), (F.col("lang") == F.col("lang_pred")).cast("double"))).alias("accepted")).first()
    assert right.accepted > 0.98


def test_toxicity_held_out(spark, labels):
    got = llm.op10_toxicity(spark, data_dir("0.1")).join(labels, "doc_id").where("held_out").persist()
    tp = got.where("predicted = 1 and toxic = 1").count()
    assert tp > 0.75 * got.where("toxic = 1").count() and tp > 0.9 * got.where("predicted = 1").count()


def test_toxic_spans_are_code_points_of_the_words(spark):
    texts = [(k, f"é😀 {'you utter blorgh and' if k % 2 else 'a quite fine day with'} w{k} word{k % 17}") for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)
    words = {r.text[s.start : s.end] for r in rows for s in r.toxic_spans}
    assert "blorgh" in words and words <= {"you", "utter", "blorgh", "and"}


def test_marginals_equal_enumeration():
    import itertools
    import math

    f = toxicity.Field(bias=-1.2, trans=(0.3, -0.4, 0.8))
    f.prepare()
    n, at, weight = 6, [1, 4], [2.0, 0.7]
    emit = [f.bias + (weight[at.index(i)] if i in at else 0) for i in range(n)]
    z, top = 0.0, [0.0] * n
    for tags in itertools.product((0, 1), repeat=n):
        s, before = 0.0, 0
        for i, t in enumerate(tags):
            s += emit[i] * t + {(0, 0): 0.0, (0, 1): 0.3, (1, 0): -0.4, (1, 1): 0.8}[before, t]
            before = t
        z += math.exp(s)
        for i in range(n):
            top[i] += math.exp(s) * tags[i]
    assert f.marginals(at, weight, n) == pytest.approx([top[i] / z for i in at])


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, name, data_dir("0.001")) > 0


def test_pipeline_stages_against_queries(spark):
    """The deduplication and decontamination stages keep what the queries on the same rows call kept and clean."""
    import corpus_pipeline

    d = data_dir("0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, d).collect()}
    assert kept == {r.doc_id for r in llm.op9_minhash_near_dedup(spark, d).where("kept").collect()}
    left = {r.doc_id: r.text for r in corpus_pipeline.benchmark_decontamination(spark, docs, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in llm.op6_benchmark_decontamination(spark, d).collect():
        if not r.contaminated:
            assert left[r.doc_id] == texts[r.doc_id]
        elif 2 * r.n_hit >= r.n_words:
            assert r.doc_id not in left
        else:
            assert left[r.doc_id] != texts[r.doc_id]
    out = corpus_pipeline.run(spark, d)
    assert set(docs.columns) < set(out.columns) and out.where("not round_trip").count() == 0
    assert out.where("n_chars <> length(text)").count() == 0 and 0 < out.count() < docs.count()
