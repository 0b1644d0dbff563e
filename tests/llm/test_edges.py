"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from loamstone.llm import decontam, langid, lm, lz, minhash, pii, quality, spm, token_counts, toxicity
from loamstone.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
CLASH = ["score", "predicted", "ids", "n_words", "items", "spans", "fingerprint", "lang_pred", "toxic_spans", "contaminated", "n_tokens", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (5, "same words here again and again"), (6, "same words here again and again"), (None, "no id at all"), (7, "word " * 40_000), (8, "x" * 100_000), (9, "ünï çödé 漢字 😀 a@b.co"), (10, None)]


def rows(n=None):
    return [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None, *("keep" for _ in CLASH)) for k, (i, t) in enumerate(TEXTS[:n])]


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(k, k % 2, None if k == 3 else 1 - k % 2) for k in range(12)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id")], "item_id long, text string")
    return labels, bench


OPS = {
    "pii": lambda d, labels, bench: pii.find(d),
    "redact": lambda d, labels, bench: pii.redact(d),
    "encode": lambda d, labels, bench: spm.encode(d, PIECES),
    "round_trip": lambda d, labels, bench: spm.round_trip(d, PIECES),
    "count": lambda d, labels, bench: token_counts.count_tokens(d, [token_counts.Words()]),
    "fingerprints": lambda d, labels, bench: lz.fingerprints(d),
    "edit_likeness": lambda d, labels, bench: lz.edit_likeness(d),
    "lm": lambda d, labels, bench: lm.score(d, lm.train(d.where(~lm.held_out_tenth())), held_out=lm.held_out_tenth()),
    "decontam": lambda d, labels, bench: decontam.find_contamination(d, bench),
    "quality": lambda d, labels, bench: quality.score(d, quality.train(d, labels)),
    "langid": lambda d, labels, bench: langid.predict(d, langid.train(d)),
    "minhash": lambda d, labels, bench: minhash.near_duplicates(d),
    "toxicity": lambda d, labels, bench: toxicity.score(d, toxicity.train(d, labels)),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_and_empty_tables(spark, tables, name):
    odd = spark.createDataFrame(rows(), SCHEMA)
    got = OPS[name](odd, *tables).collect()
    assert len(got) == len(TEXTS)
    assert OPS[name](spark.createDataFrame([], SCHEMA), *tables).count() == 0
    bare = OPS[name](odd, *(t.limit(0) for t in tables)).count()
    assert bare == len(TEXTS)


def test_clashing_columns_pass_through(spark, tables):
    odd = spark.createDataFrame(rows(), SCHEMA)
    for kept, made in (("spans", pii.redact(odd)), ("predicted", decontam.find_contamination(odd, tables[1])), ("score", minhash.keep_one(odd)), ("items", decontam.find_contamination(odd, tables[1], action="excise"))):
        assert {r[kept] for r in made.collect()} == {"keep"}


def test_pipeline_on_odd_tables(spark, tables, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    tables[0].write.parquet(f"{d}/labels.parquet")
    tables[1].write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert got and all(r.round_trip for r in got)
    assert sum(r.text is not None and r.text.startswith("same words") for r in got) <= 1
