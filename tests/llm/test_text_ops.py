"""Operators with exact answers against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from harness import data_dir
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import decontam, lm, lz, minhash, pii, spm, token_counts
from loamstone.llm.common import ALNUM, row_words
from loamstone.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@", "@y.z", "1.2.3.4", "999.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (459) 555-9246", "+12", " ", "é", "😀", "-", "_", "0001.2.3.4", "\n", "+", "(at)", "55"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["a@b.c" * 300, "+12345678 " * 300, "1.1.1.1 " * 700, "9" * 3000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert [tuple(x) for x in r.base_spans] == base_spans(r.text), r.text
        for k, s, e in r.more_spans:
            assert not any(a < e and s < b for _, a, b in base_spans(r.text)), (k, r.text)


def test_pii_further_spans_and_redaction(spark):
    text = "Call Dr. Alice Smith, SSN: 123-45-6789, phone (555) 123-4567, IBAN DE89 3704 0044 0532 0130 00, mail joe@site.com. Version 2.0 has 17 parts."
    docs = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    model = pii.train(docs)
    r = pii.find(docs, model).first()
    assert {k for k, _, _ in r.more_spans} >= {"national", "local_phone", "account", "person"}
    assert pii.redact(docs, model).first().text == "Call [PERSON], SSN: [NATIONAL], phone [LOCAL_PHONE], IBAN [ACCOUNT], mail [EMAIL]. Version 2.0 has 17 parts."


def test_em_trusts_agreeing_labelers():
    import numpy as np

    votes = np.array([[1, 1, 1], [1, 1, -1], [-1, -1, 1], [-1, -1, -1]])
    post, prior, table = pii.estimate(votes, np.array([40.0, 30.0, 30.0, 40.0]))
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1 and post[3] < 0.1
    assert table[0, 1, 2] > 0.9 > table[2, 1, 2]


ODD = ["", None, "a", " ", "  ", "   hello   world  ", "\n\n\t x", "日本語のテキスト 漢字", "emoji 😀😀 x", "a" * 1000, "abc" * 400 + " " + "x" * 300, "\x00a\x00 b", "▁▁foo ▁", " " * 40, "é" * 500, "the the the", "​﻿q"]


def test_pieces_equal_the_public_library(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [r.text for r in spark.read.parquet(data_dir("0.001") + "/documents.parquet").collect()]
    flat, at = spm.encode_batch(spm.load(PIECES), pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == p.encode(t or ""), t
    back = spm.decode_ids(spm.load(PIECES), flat, at)
    assert all(b == (t or "").replace("▁", " ") for b, t in zip(back, texts, strict=True))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    for r in spm.decode(spm.encode(docs, PIECES), PIECES, to="back").collect():
        assert r.back == (r.text or "").replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_pieces_on_any_text(texts):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    flat, at = spm.encode_batch(spm.load(PIECES), pa.array(texts, pa.string()))
    assert [flat[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [p.encode(t) for t in texts]


def test_ledger_is_idempotent_and_additive(spark, tmp_path):
    kinds = [token_counts.Words(), token_counts.ByteBpe("bpe", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")]
    first = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d e", "s", "fr"), (3, None, None, "en")], "doc_id long, text string, source string, lang string")
    second = spark.createDataFrame([(1, "a b c d", "s", "en"), (3, None, None, "en"), (4, "x", "t", "en")], first.schema)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    a, b = token_counts.count_tokens(first, kinds), token_counts.count_tokens(second, kinds)
    assert ledger.commit("load", token_counts.inserts(a)) and not ledger.commit("load", token_counts.inserts(a))
    # An attempt that never committed is not read.
    token_counts.inserts(a).write.parquet(f"file://{tmp_path}/ledger/deltas/load.lost")
    words = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().where("tokenizer = 'words'").collect()}
    assert words() == {("s", "en"): (1, 3), ("s", "fr"): (1, 2), (None, "en"): (1, 0)}
    assert ledger.commit("revise", token_counts.changes(a, b))
    want = {("s", "en"): (1, 4), (None, "en"): (1, 0), ("t", "en"): (1, 1)}
    assert words() == want
    ledger.compact()
    assert words() == want
    assert not ledger.commit("revise", token_counts.changes(a, b))
    with pytest.raises(ValueError):
        ledger.commit("../x", token_counts.inserts(a))


def test_bpe_counts_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    docs = spark.read.parquet(data_dir("0.001") + "/documents.parquet")
    got = {r.doc_id: (r.text, r.n_tokens) for r in token_counts.count_tokens(docs, [token_counts.ByteBpe("b", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")], keep=["doc_id", "text"]).collect()}
    assert all(n == len(t.encode(x, add_special_tokens=False).ids) for x, n in got.values())


def test_edited_texts_and_likeness(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = {k * 3: " ".join(word() for _ in range(rng.choice([0, 1, 50, 400]))) for k in range(40)} | {200: "é😀" * 31, 300: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lz.edit_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(a) // 3
        edited = a[: len(a) - third] + b[:third]
        r = got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(a) > 1000:
            assert r.near_edited > 0.3 > r.near_next
        if edited == a:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0


def kneser_ney(texts):
    """Plain dictionaries: base and model scores as functions of a text."""
    tok = lambda x: [w.decode("utf-8", "surrogateescape") for w in (x or "").encode().lower().split()] + [None]
    c, big = Counter(), Counter()
    for t in map(tok, texts):
        c.update(t)
        big.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    total, follow, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), k in big.items():
        total[a] += k
        follow[a][min(k, 3) - 1] += 1
        cont[b] += 1

    def discounts(values):
        m = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        return [1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2]]

    d2, d1 = discounts(big.values()), discounts(cont.values())
    many = Counter(min(x, 3) for x in cont.values())
    spare = sum(d1[k - 1] * many[k] for k in (1, 2, 3)) / len(big)
    low = lambda w: (max(cont[w] - d1[min(cont[w], 3) - 1], 0) if cont[w] else 0) / len(big) + spare / (v + 1)

    def p(a, b):
        if not total[a]:
            return low(b)
        k = big[a, b]
        return (k - d2[min(k, 3) - 1] if k else 0) / total[a] + sum(x * y for x, y in zip(d2, follow[a], strict=True)) / total[a] * low(b)

    base = lambda x: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(x))
    best = lambda x: sum(math.log10(p(a, b)) for a, b in zip(["<s>", *tok(x)[:-1]], tok(x), strict=True))
    return tok, c, n, base, best, p


def test_language_model_equals_plain_dictionaries(spark):
    docs = spark.read.parquet(data_dir("0.001") + "/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    tok, c, n, base, best, p = kneser_ney([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10])
    assert abs(sum(p("the", w) for w in c) + p("the", "never seen") - 1) < 1e-9
    got = lm.score(docs, lm.train(docs.where(~lm.held_out_tenth())), held_out=lm.held_out_tenth()).collect()
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        t = text[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok(t)), sum(w in c for w in tok(t)), n)
        assert r.base_score == pytest.approx(base(t), rel=1e-9) and r.score == pytest.approx(best(t), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def brute_hits(text, items):
    norm = lambda x: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (x or "").translate({k: k + 32 for k in range(65, 91)}))
    w, hit, found = norm(text), set(), set()
    for k, item in items:
        i = norm(item)
        n = min(len(i), 13)
        windows = {tuple(i[s : s + n]) for s in range(len(i) - n + 1)} if i else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("a b c d e f".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(40)] + [(90, None)]
    texts = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        if k % 3:
            parts += [rng.choice(items)[1] or "", "É-x", " ".join(word() for _ in range(20))]
        texts.append((k, ", ".join(parts).upper() if k % 2 else " ".join(parts)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for blocks in (10**6, 60):
        got = {r.doc_id: r for r in decontam.find_contamination(docs, bench, block_words=blocks).collect()}
        for i, t in texts:
            n, hit, found = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hit, found)
            assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_excised_text_has_no_hit(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"Before it. {item.title()}! After it."), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = decontam.find_contamination(docs, bench, action="excise")
    assert [r.text for r in cut.orderBy("doc_id").collect()] == ["Before it. ! After it.", "clean"]
    assert [r.doc_id for r in decontam.find_contamination(docs, bench, action="drop").collect()] == [2]


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    """Groups of graded edits: many pairs lie just under the threshold, and chains link what no pivot does."""
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    texts, k = [], 0
    for group in range(6):
        base = [word() for _ in range(rng.choice([3, 7, 60, 200]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = word()
            texts.append((1000 - k, " ".join(w)))
            k += 1
            if rng.random() < 0.3:
                base = w  # the group drifts
    texts += [(2000 + i, texts[i % 50][1]) for i in range(60)] + [(5000, None), (5001, ""), (5002, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = brute_components(texts)
    for block in (1024, 16):
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, block=block).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = {r.doc_id for r in minhash.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_min_max_signature_is_unbiased():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    got = []
    for _ in range(60):
        every = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        a, b = np.unique(every[:400]), np.unique(every[100:])
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - 300 / 500) < 0.02


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB1 -é\n", max_size=20), min_size=1, max_size=6))
def test_words_are_hashed_alike_wherever_they_stand(texts):
    hashes, rows = row_words(pa.array(texts), ALNUM)
    seen = {}
    for k, t in enumerate(texts):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        own = hashes[rows[k] : rows[k + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
