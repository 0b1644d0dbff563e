"""Queries of the classifiers against the same models in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from harness import data_dir

from loamstone.llm import langid, quality
from loamstone.llm import queries as llm


def plain_features(text):
    t = text or ""
    raw = t.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw.lower())
    n, size = len(words), len(raw)
    share = lambda a, b: a / b if b else 0.0
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    symbol = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"}
    grams = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    count = Counter(words)
    cased = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    return [
        math.log1p(n),
        share(sum(b not in b" \t\n\v\f\r" for b in raw), n),
        len(count) / n if n else 1.0,
        max(count.values()) / n if n else 1.0,
        share(sum(65 <= b <= 90 for b in raw), letters),
        share(sum(b in symbol for b in raw), size),
        share(raw.count(b"!"), n),
        share(raw.count(b"|"), n),
        share(sum(48 <= b <= 57 for b in raw), size),
        share(raw.count(b"."), n),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        len(set(grams)) / len(grams) if grams else 1.0,
        len(set(lines)) / len(lines) if len(lines) > 1 and n else 1.0,
        share(sum(w[-1] in symbol for w in cased), n),
        share(sum(b >= 128 for b in raw), size),
        math.log1p(size),
    ]


def place(edges, v):
    return sum(e <= v for e in edges.tolist())


def test_quality_query_in_plain_python(spark):
    d = data_dir("0.001")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in llm.op7_quality_classifier(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = plain_features(r.text)
        total = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        total += sum(t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for (i, j), t in model.pairs.items())
        p = 1 / (1 + math.exp(-total))
        assert got[r.doc_id].score == pytest.approx(p, abs=1e-9) and got[r.doc_id].predicted == (p >= 0.5)


def plain_tree(bins, g, h, n, ridge):
    """Two levels of best cuts by trying all of them."""

    def best(lo, hi):
        top, cut = None, lo
        for c in range(lo + 1, hi):
            parts = [(sum(x for b, x in zip(bins, g, strict=True) if s <= b < e), sum(x for b, x in zip(bins, h, strict=True) if s <= b < e)) for s, e in ((lo, c), (c, hi))]
            gain = sum(a * a / (b + ridge) for a, b in parts)
            if top is None or gain > top + 1e-12:
                top, cut = gain, c
        return cut

    mid = best(0, n)
    leaves = []
    for lo, hi in ((0, mid), (mid, n)):
        inner = best(lo, hi)
        for a, b in ((lo, inner), (inner, hi)):
            if a < b:
                leaves.append((a, b, -sum(x for k, x in zip(bins, g, strict=True) if a <= k < b) / (sum(x for k, x in zip(bins, h, strict=True) if a <= k < b) + ridge)))
    return leaves


def test_tables_are_the_sum_of_their_trees():
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.random((60, 3))
    y = (x[:, 0] + 0.3 * rng.random(60) > 0.6).astype(float)
    model = quality.fit(x, y, rounds=3, pair_rounds=0, bins=6)
    f = [model.base] * 60
    trees = []
    for _ in range(3):
        for k in range(3):
            p = [1 / (1 + math.exp(-v)) for v in f]
            bins = [place(model.edges[k], v) for v in x[:, k]]
            leaves = plain_tree(bins, [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], len(model.edges[k]) + 1, 5.0)
            trees.append((k, leaves))
            f = [v + 0.15 * next(w for a, b, w in leaves if a <= c < b) for v, c in zip(f, bins, strict=True)]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in f], atol=1e-9)
    for k in range(3):
        summed = [0.15 * sum(next(w for a, b, w in leaves if a <= c < b) for j, leaves in trees if j == k) for c in range(len(model.tables[k]))]
        assert np.allclose(model.tables[k], summed, atol=1e-9)


def plain_buckets(text):
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
    out = []
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            h = n * 0x01000193
            for j in range(n):
                h = ((h ^ raw[i + j]) * int(langid._MULT[j])) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - langid.BITS))
    return out


def test_language_query_in_plain_python(spark):
    d = data_dir("0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: r for r in llm.op8_language_id(spark, d).collect()}
    table, bias = model.table.astype(float).tolist(), model.bias.tolist()
    short = [r for r in docs.collect() if len(r.text or "") < 4000]
    assert len(short) > 100
    for r in short:
        own = plain_buckets(r.text)
        z = [(sum(table[b][k] for b in own) / max(len(own), 1) + bias[k]) / model.temperature for k in range(len(model.langs))]
        e = [math.exp(v - max(z)) for v in z]
        p = [v / sum(e) for v in e]
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == model.langs[p.index(max(p))] and got[r.doc_id].score == pytest.approx(max(p), abs=1e-4)
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)


def test_embeddings_and_softmax_descend_as_in_plain_python():
    texts = [("der hund und die katze", 0), ("the dog and the cat", 1), ("und der vogel", 0), ("a bird and some fish", 1)]
    bags = []
    for t, _ in texts:
        own = Counter(plain_buckets(t))
        ids = np.array(sorted(own), np.uint16)
        bags.append((ids, np.array([own[int(i)] for i in ids], np.float32) / sum(own.values())))
    y = np.array([k for _, k in texts])
    model = langid.fit(bags, y, ["de", "en"], epochs=3)
    rng = np.random.Generator(np.random.PCG64(7))
    emb = ((rng.random((1 << langid.BITS, langid.WIDTH), dtype=np.float32) - 0.5) / langid.WIDTH).astype(float)
    out = ((rng.random((langid.WIDTH, 2), dtype=np.float32) - 0.5) * 0.5).astype(float).tolist()
    rows = {int(i): emb[i].tolist() for ids, _ in bags for i in ids}
    bias, step = [0.0, 0.0], 0
    for _ in range(3):
        for k in rng.permutation(np.arange(4)).tolist():
            ids, share = bags[k][0].tolist(), bags[k][1].tolist()
            rate = 0.2 * (1 - step / 12)
            step += 1
            hidden = [sum(s * rows[i][w] for i, s in zip(ids, share, strict=True)) for w in range(langid.WIDTH)]
            z = [sum(hidden[w] * out[w][c] for w in range(langid.WIDTH)) + bias[c] for c in (0, 1)]
            e = [math.exp(v) for v in z]
            err = [v / sum(e) - (c == y[k]) for c, v in enumerate(e)]
            back = [sum(out[w][c] * err[c] for c in (0, 1)) for w in range(langid.WIDTH)]
            for w in range(langid.WIDTH):
                for c in (0, 1):
                    out[w][c] -= rate * hidden[w] * err[c]
            bias = [b - rate * 0.1 * v for b, v in zip(bias, err, strict=True)]
            square = max(sum(s * s for s in share), 1e-3)
            for i, s in zip(ids, share, strict=True):
                rows[i] = [v - rate / square * s * b for v, b in zip(rows[i], back, strict=True)]
    for i, row in rows.items():
        assert np.allclose(model.table[i], [sum(row[w] * out[w][c] for w in range(langid.WIDTH)) for c in (0, 1)], atol=1e-4)
    assert np.allclose(model.bias, bias, atol=1e-5)
