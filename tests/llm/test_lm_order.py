"""The language model at orders above 2 against plain dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import harness
import numpy as np
import pytest

from loamstone.llm import lm


def kneser_ney(texts, order):
    """Function of a text: log10 scores of its tokens by an interpolated modified Kneser-Ney model."""
    tok = lambda x: ["<s>", *(w.decode("utf-8", "surrogateescape") for w in (x or "").encode().lower().split()), None]
    raw = [Counter() for _ in range(order + 1)]
    for t in map(tok, texts):
        for n in range(1, order + 1):
            raw[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    use = [Counter(), *(Counter() for _ in range(order))]
    use[order] = raw[order]
    for n in range(1, order):
        use[n].update(g[1:] for g in raw[n + 1])
        if n > 1:
            use[n].update({g: c for g, c in raw[n].items() if g[0] == "<s>"})
    d = [None]
    for n in range(1, order + 1):
        m = [sum(x == k for x in use[n].values()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        # As in the operator, no discount leaves (0, its count); on this small table some of order 4 would.
        own = [1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2]]
        d.append([min(max(x, 0.05), k + 0.95) for k, x in enumerate(own)])
    total, left = Counter(), defaultdict(float)
    for n in range(1, order + 1):
        for g, c in use[n].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[n][min(c, 3) - 1]
    kinds = len(raw[1]) - 1

    def p(g):
        """Of the last word of g after the others."""
        low = p(g[1:]) if len(g) > 1 else 1 / (kinds + 1)
        if not total[g[:-1]]:
            return low
        c = use[len(g)][g]
        return ((c - d[len(g)][min(c, 3) - 1] if c else 0) + left[g[:-1]] * low) / total[g[:-1]]

    def score(x):
        t = tok(x)
        return [math.log10(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t))]

    return score, p, [g[0] for g in raw[1] if g[0] != "<s>"]


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_equal_plain_dictionaries(spark, order):
    docs = spark.read.parquet(harness.data_dir("0.001") + "/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "never-seen-word the"}
    docs = spark.createDataFrame(list(text.items()), docs.schema).repartition(5)
    best, p, vocabulary = kneser_ney([t for i, t in text.items() if zlib.crc32(str(i).encode()) % 10], order)
    assert abs(sum(p(("of", "the", w)) for w in [*vocabulary, "never seen"]) - 1) < 1e-9
    got = lm.score(docs, lm.train(docs.where(~lm.held_out_tenth()), order=order), held_out=lm.held_out_tenth()).collect()
    assert len(got) == len(text)
    for r in got:
        s = best(text[r.doc_id])
        assert r.n_tokens == len(s) and r.score == pytest.approx(sum(s), rel=1e-9)


def test_registered_query_scores_held_out_rows_by_trigrams(spark):
    from loamstone.llm.queries import op5_lm_scoring

    docs = spark.read.parquet(harness.data_dir("0.001") + "/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    best, _, _ = kneser_ney([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10], 3)
    got = {r.doc_id: r.score for r in op5_lm_scoring(spark, harness.data_dir("0.001")).where("held_out").collect()}
    assert got and all(got[r.doc_id] == pytest.approx(sum(best(r.text)), rel=1e-9) for r in rows if r.doc_id in got)


def test_tiny_tables_at_order_3(spark):
    for texts in ([], [None], ["", "a"], ["a b", "a b", "b a b"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        scored = lm.score(spark.createDataFrame([(1, "a b c"), (2, None)], docs.schema), lm.train(docs, order=3)).collect()
        assert len(scored) == 2 and all(-100 < r.score <= 1e-12 for r in scored)


def test_counts_beyond_32_bits_are_kept(tmp_path):
    keys = np.sort(np.array([5, 1 << 40, (1 << 64) - 9, 7, 1 << 63], np.uint64))
    counts = np.array([1, 254, 255, 1 << 32, 1 << 52])
    held = lm._chunks(keys, counts, 3).to_pylist()
    assert np.concatenate([lm._full(r["k"]) for r in held]).tolist() == keys.tolist()
    assert np.concatenate([lm._counts(r["n"], r["size"]) for r in held]).tolist() == counts.tolist()
    lm._write(f"{tmp_path}/0", [keys])
    lm._write(f"{tmp_path}/0.n", lm._packed(counts))
    table = lm.Table(str(tmp_path), [len(keys)])
    assert table.column("n", table.find(keys)).tolist() == counts.tolist()
