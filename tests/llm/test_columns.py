"""Columns that share names with helpers keep their values; repeated rows and ties get equal results."""

import pytest
from pyspark.sql import functions as F

from loamstone.llm import decontam, langid, lz, minhash, pii, quality, spm, token_counts, toxicity
from loamstone.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
HELPERS = ["__text", "__letter", "__score", "__predicted", "__hits", "__row", "row", "__base", "__more", "__base_spans", "__m_email", "__g_more", "__s_ip", "class", "signature", "small", "label", "near", "h", "r", "ghost", "at", "bucket", "key", "component", "size"]
MADE = ["base_spans", "more_spans", "ids", "n_pieces", "round_trip", "fingerprint", "n_words", "n_hit", "items", "contaminated", "score", "predicted", "lang_pred", "rejected", "toxic_spans", "tokenizer", "n_tokens"]
NAMES = HELPERS + MADE
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in NAMES)
TEXTS = ["call me at a.b@c.org", "call me at a.b@c.org", "", None, "ein kurzer satz über nichts", "one two three four five six seven", "one two three four five six seven", "漢字 ünï"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "de", "s", *(f"{c}:{k}" for c in NAMES)) for k, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "three four five"), (2, "nowhere")], "item_id long, text string")
    return docs, labels, bench


OPS = {
    "pii": (lambda d, labels, bench: pii.find(d), ["base_spans", "more_spans"]),
    "redact": (lambda d, labels, bench: pii.redact(d), ["text"]),
    "encode": (lambda d, labels, bench: spm.encode(d, PIECES, check=True), ["ids", "n_pieces", "round_trip"]),
    "decode": (lambda d, labels, bench: spm.decode(spm.encode(d, PIECES), PIECES), ["text", "ids"]),
    "fingerprints": (lambda d, labels, bench: lz.fingerprints(d), ["fingerprint"]),
    "mark": (lambda d, labels, bench: decontam.find_contamination(d, bench), ["n_words", "n_hit", "items", "contaminated"]),
    "mark in blocks": (lambda d, labels, bench: decontam.find_contamination(d, bench, block_words=1), ["n_words", "n_hit", "items", "contaminated"]),
    "quality": (lambda d, labels, bench: quality.score(d, quality.train(d, labels)), ["score", "predicted"]),
    "langid": (lambda d, labels, bench: langid.predict(d, langid.train(d)), ["lang_pred", "score", "rejected"]),
    "toxicity": (lambda d, labels, bench: toxicity.score(d, toxicity.train(d, labels)), ["score", "predicted", "toxic_spans"]),
}


@pytest.mark.parametrize("name", OPS)
def test_other_columns_pass_through(spark, tables, name):
    docs = tables[0]
    run, made = OPS[name]
    got = run(*tables)
    assert len(got.columns) == len(set(got.columns)) and set(docs.columns) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert sorted(rows) == list(range(len(TEXTS)))
    for k, r in rows.items():
        assert [r[c] for c in NAMES if c not in made] == [f"{c}:{k}" for c in NAMES if c not in made]
        if "text" not in made:
            assert r.text == TEXTS[k]
    for a, b in ((0, 1), (5, 6)):  # equal texts, equal results
        assert [rows[a][c] for c in made] == [rows[b][c] for c in made]


def test_stages_that_drop_rows(spark, tables):
    docs = tables[0]
    for got, gone in ((minhash.keep_one(docs), {1, 6}), (minhash.keep_one(docs.union(docs.where("doc_id = 4"))), {1, 6}), (decontam.find_contamination(docs, tables[2], action="drop"), {5, 6})):
        rows = got.collect()
        assert got.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(set(range(8)) - gone)
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in NAMES)


def test_counts_keep_columns(tables):
    keep = [c for c in NAMES if c not in ("tokenizer", "n_tokens")]
    rows = token_counts.count_tokens(tables[0], [token_counts.Words()], keep=["doc_id", *keep]).collect()
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in keep)
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len((t or "").split()) for k, t in enumerate(TEXTS)}


def test_pipeline_stages_keep_columns(spark, tables, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    docs = tables[0].withColumnRenamed("size", "n_chars")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    tables[1].write.parquet(f"{d}/labels.parquet")
    tables[2].write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
        assert all(r[c] == f"{c}:{r.doc_id}" for r in got.collect() for c in NAMES if c != "size"), name


def test_keys_that_tie(spark, tables):
    """Copies under many ids, and ids under many rows, leave one row each whatever their order."""
    rows = [(k % 5, "same text of seven words in all") for k in range(20)]
    got = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [tuple(r) for r in got] == [(0, rows[0][1])]
    near = lz.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(near) == 20 and {(r.near_edited, r.near_next) for r in near} == {(near[0].near_edited, 1.0)}
