"""A benchmark of many blocks: the results of one block, and never two blocks at once."""

import random

from loamstone.llm import decontam


def tables(spark):
    rng = random.Random(5)
    items = [(k if k % 7 else None, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 13, 14, 40])))) for k in range(60)] + [(900, ""), (901, None)]
    texts = []
    for k in range(80):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([0, 5, 60]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(items[:60])[1].split()
        texts.append((k, " ".join(words) if k else None, "keep", "own"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, __hits string, spans string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_blocks_change_nothing(spark):
    docs, bench = tables(spark)
    for action in ("mark", "drop", "excise"):
        one, many = (sorted(map(str, decontam.find_contamination(docs, bench, action=action, block_words=n).collect())) for n in (500_000, 50))
        assert one == many and one
    held = [sum(len(w) for _, w in b) for b in decontam._item_blocks(bench, 50, "item_id", "text")]
    assert len(held) > 5 and max(held) <= 50


def test_brute_force(spark):
    docs, bench = tables(spark)
    items = [(r.item_id, (r.text or "").split()) for r in bench.collect()]
    for r in decontam.find_contamination(docs, bench, block_words=50).collect():
        words = (r.text or "").split()
        hit, found = set(), set()
        for k, w in items:
            n = min(len(w), 13)
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(None if k is None else str(k))
        assert (r.n_words, r.n_hit, set(r.items)) == (len(words), len(hit), found)
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(words)) and r["__hits"] == "keep"


def test_excised_texts_hold_no_window(spark):
    docs, bench = tables(spark)
    cut = decontam.find_contamination(docs, bench, action="excise", drop_from=0.5)
    marked = {r.doc_id: r for r in decontam.find_contamination(docs, bench).collect()}
    got = {r.doc_id: r.text for r in cut.collect()}
    for k, r in marked.items():
        if r.contaminated and 2 * r.n_hit >= r.n_words:
            assert k not in got
        elif not r.contaminated:
            assert got[k] == r.text
        else:
            assert len(got[k].split()) == r.n_words - r.n_hit
