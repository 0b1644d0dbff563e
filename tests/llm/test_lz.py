"""Fingerprints against exact phrase sets, and order where ids repeat or are missing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loamstone.llm import lz


def exact(text):
    """LZ78 phrases by plain tuples of pieces of at most 16 bytes."""
    symbols = []
    for w in (text or "").encode().split():
        symbols += [w[i : i + 16] for i in range(0, len(w), 16)]
    known, now = set(), ()
    for s in symbols:
        now += (s,)
        if now not in known:
            known.add(now)
            now = ()
    return known


def test_likeness_is_that_of_phrase_sets():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.choice([2, 3, 9, 15, 16, 17, 33, 65])))
    words = [word() for _ in range(300)]
    texts = []
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.choice([10, 100, 900]))]
        texts += [" ".join(own), " ".join(own[: len(own) * 2 // 3] + [rng.choice(words) for _ in range(len(own) // 3)])]
    texts += ["漢字" * 300, "漢字" * 200 + "仮名" * 100]
    sig, full = lz.signatures(pa.array(texts))
    errors = []
    for k in range(0, len(texts), 2):
        p, q = exact(texts[k]), exact(texts[k + 1])
        got = lz.likeness(sig[k : k + 1], sig[k + 1 : k + 2], full[k : k + 1], full[k + 1 : k + 2])[0]
        errors.append(got - len(p & q) / len(p | q))
        assert len(lz.phrases(lz.span_hashes(*_spans(texts[k])).tolist())) == len(p)
    # 128 values: a standard error of at most 0.045.
    assert np.abs(errors).max() < 0.18 and abs(np.mean(errors)) < 0.025


def _spans(text):
    data, offsets = lz.text_buffer(pa.array([text]))
    return data, *lz._pieces(*lz.word_spans(data, offsets, lz.NONSPACE)[:2])


def test_ids_that_hold_most_rows(spark):
    rng = random.Random(2)
    rows = [(None, f"null {k} " + "t " * rng.randrange(9)) for k in range(300)] + [(50, f"fifty {k} é") for k in range(300)] + [(k, f"own {k}") for k in range(100) if k != 50] + [(50, "same")] * 5 + [(None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lz.edit_likeness(docs).collect()
    assert len(got) == len(rows)
    dealt = lz._neighbours(docs, 4).where("ghost = 0").groupBy("r").count().collect()
    assert max(r["count"] for r in dealt) < 120 < len(rows) / 3
    h = {t: v for t, v in docs.selectExpr("text", "xxhash64(coalesce(text, ''))").collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]], x[1] is not None, x[1] or ""))
    want = Counter()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        x, y = a[1] or "", b[1] or ""
        third = len(x) // 3
        want[a[0], len(x), hashlib.sha256((x[: len(x) - third] + y[:third]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
