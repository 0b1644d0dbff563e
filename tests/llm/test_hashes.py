"""Words on which a polynomial modulo 2**64 collides, through every operator that hashes words."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from loamstone.llm import common, decontam, lm, minhash, spm
from loamstone.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def thue_morse(n, a="a", b="b"):
    s = a
    flip = str.maketrans(a + b, b + a)
    while len(s) < n:
        s += s.translate(flip)
    return s[:n]


@pytest.mark.parametrize("n", [32, 64, 1024, 2048, 4096])
def test_spans_of_two_letters(n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    data = np.frombuffer((one + " " + two + " " + one).encode(), np.uint8)
    starts = np.array([0, n + 1, 2 * n + 2])
    h = common.span_hashes(data, starts, starts + n)
    assert h[0] == h[2] != h[1]


def test_ids_equal_the_public_library():
    texts = [thue_morse(2048), thue_morse(2048, "b", "a"), thue_morse(2048) + " x", "a b " * 50]
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)
    model = spm.Model(PIECES)
    for _ in range(2):
        flat, at = spm.encode_batch(model, pa.array(texts))
        assert [flat[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == want


def test_ids_when_every_hash_collides(monkeypatch):
    """Ids come from the units' bytes even if all units of a length share one hash."""
    monkeypatch.setattr(spm, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two six ten", "bad cat dog", "", "naïve 漢字 text"]
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)
    model = spm.Model(PIECES)
    for column in (pa.array(texts[:1]), pa.array(texts), pa.array(texts[::-1])):
        flat, at = spm.encode_batch(model, column)
        got = [flat[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)]
        assert got == [want[texts.index(t)] for t in column.to_pylist()]


def test_operators_tell_such_words_apart(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    docs = spark.createDataFrame([(1, f"{one} p q r s t"), (2, f"{two} p q r s t"), (3, f"{one} p q r s t"), (4, f"{one} {one} {two}")], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontam.find_contamination(docs, bench).collect()}
    assert hit == {1: 1, 2: 0, 3: 1, 4: 2}
    model = lm.train(docs.where("doc_id < 4"))
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    c, total, kinds = {one: 2, two: 1, "end": 3}, 21, 8
    base = sum(np.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in (c[one], c[one], c[two], c["end"]))
    assert got[4].n_known == 4 and abs(got[4].base_score - base) < 1e-9
    assert hashlib.blake2b(one.encode()).digest() != hashlib.blake2b(two.encode()).digest()
