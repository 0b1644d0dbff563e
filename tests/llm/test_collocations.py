"""Collocations against plain counting; odd texts, collisions, parts and unjudged sums."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loamstone.llm import collocations as C


def plain(rows, longest=3, least=10, top=2000, percent=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, g), a in found.items():
        score, k, left, right = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        if not any(x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= percent * a for (x, h), b in found.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return {(lang, r + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for r, (s, a, p, left, right) in enumerate(sorted(xs)[:top])}


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(k % 7 or None, *r, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, words string").repartition(4)
    got = C.mine(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢字", "a" * 70, "x\u00a0y", "b", "c", "d"]
    one = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "-"]) for _ in range(rng.randint(0, 60)))
    return [(one() + rng.choice(["New York City", "in New York.", ""]), rng.choice(["en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", "fr"), (" \t\n", None), ("q " * 300, "en"), ("only once here", "es")]


@pytest.mark.parametrize("how", [{}, {"longest": 2}, {"longest": 4, "least": 5, "covered_percent": 30}, {"top": 3}, {"least": 1, "longest": 3, "top": 50}])
def test_equals_plain_counting(spark, how):
    rows = texts()
    want = plain(rows, **{{"covered_percent": "percent"}.get(k, k): v for k, v in how.items()})
    assert mined(spark, rows, **how) == want and len(want) > 8


def test_small_stretches_parts_and_unjudged_sums(spark, monkeypatch):
    rows = texts(2, 200)
    want = mined(spark, rows)
    monkeypatch.setattr(C, "STRETCH", 50)
    monkeypatch.setattr(C, "FLUSH", 90)
    assert mined(spark, rows) == want
    monkeypatch.setattr(C, "AT_ONCE", 5)
    monkeypatch.setattr(C, "MOST", 3)
    assert mined(spark, rows) == want == plain(rows)


def test_a_prefix_that_is_given_out_unjudged():
    """Sums of one prefix that outgrow the memory set aside go on whole, those after it too."""
    C_MOST, least = C.MOST, 3
    p = C._Prefixes(least)
    rows = lambda prefix, seconds: [np.zeros(len(seconds), np.int32), np.zeros(len(seconds), np.int32), np.full(len(seconds), prefix), np.array(seconds), np.ones(len(seconds), np.int64)]
    C.MOST = 4
    try:
        out = Counter()
        for part in (rows(1, [5] * 3 + [6]), rows(2, list(range(10, 16))), rows(2, [10, 10, 30]), rows(3, [7, 7, 8, 8, 8])):
            p.waiting.append(part)
            for (_, first, second), count in p.given(False):
                out.update(dict(zip(zip(first.tolist(), second.tolist(), strict=True), count.tolist(), strict=True)))
        for (_, first, second), count in p.given(True):
            out.update(dict(zip(zip(first.tolist(), second.tolist(), strict=True), count.tolist(), strict=True)))
    finally:
        C.MOST = C_MOST
    assert out == Counter({(1, 5): 3, (2, 10): 3, **{(2, k): 1 for k in range(11, 16)}, (2, 30): 1, (3, 8): 3})


def test_words_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    rows = [("one two. two one. one two one " * 5, "en"), ("one two " * 20, "de")]
    want, used = plain(rows), []
    first = C.span_hashes

    class Words:
        data = np.frombuffer(b"one two one", np.uint8)
        starts, ends, lang = np.array([0, 4, 8]), np.array([3, 7, 11]), np.zeros(3, np.int32)

    assert C._unlike(Words, np.zeros(3, int)).tolist() == [1]
    texts_ = spark.createDataFrame(rows, "text string, lang string")
    real = C.word_counts

    def weak(df, seed=0):
        used.append(seed)
        return real(df, seed) if seed else real(df, seed).selectExpr("CAST(1 AS BIGINT) AS id", "lang", "word", "f")

    monkeypatch.setattr(C, "word_counts", weak)
    assert C._numbered(texts_)[1] == 1 and used == [0, 1]
    assert mined(spark, rows) == want and first is C.span_hashes


def test_frequent_places(spark):
    ids = [0, 1, -1, 5, C.PLACES + 7, 2**62 + 32768, -(2**63)]
    words = spark.createDataFrame([(i, 10) for i in ids] + [(3, 9)], "id long, f long")
    places = C._frequent_places(words, 10)
    assert sorted(np.flatnonzero(places).tolist()) == sorted({i % C.PLACES for i in ids})


def test_large_counts_and_empty_tables(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", [1, 2], big), ("en", [1, 2, 3], big - 1)], "lang string, words array<long>, a long")
    phrases = phrases.union(spark.createDataFrame([("en", [2, 3], big + 5)], phrases.schema))
    words = spark.createDataFrame([(1, "en", "x", 7 * 10**13), (2, "en", "y", 9 * 10**13), (3, "en", "z", big + 9)], "id long, lang string, word string, f long")
    got = {tuple(r.words): (r.l, r.r, r.score) for r in C.scored(phrases, words, 10).collect()}
    assert got[1, 2] == (7 * 10**13, 9 * 10**13, 10**6 * big * big // (63 * 10**26))
    a = big - 1
    assert got[1, 2, 3] == min((10**6 * a * a // (x * y), k, (x, y)) for k, x, y in ((1, 7 * 10**13, big + 5), (2, big, big + 9)))[2] + (10**6 * a * a // (7 * 10**13 * (big + 5)),)
    assert mined(spark, [(None, None)]) == {} and C.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        C.mine(phrases, longest=1)


def test_one_long_text(spark):
    text = "alpha beta gamma " * 400_000
    got = mined(spark, [(text, "en")])
    assert got["en", 1][:2] == ("alpha beta gamma", 400_000) and got["en", 1][4] == 1_200_000
