"""What near-duplicate detection deals out for one large group, and keys of small sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from loamstone.llm import minhash


def test_near_copies_and_a_stray_cost_their_number(spark):
    n = 50_000
    members = spark.range(n + 1).select(F.lit(7).cast("long").alias("key"), "id", F.when(F.col("id") < n, 0).otherwise(n).cast("long").alias("component"), F.lit(b"x").alias("signature"))
    dealt = minhash._blocks(members, minhash._mixed(members, "key"), "key", 256)
    assert dealt.count() <= n + n / 256 + 2
    met = dealt.groupBy("p", "q").agg(F.count_if(F.col("id") < n).alias("group"), F.count_if(F.col("id") == n).alias("stray"))
    assert met.agg(F.sum("group")).first()[0] == n and met.where("stray = 0 and group > 0").count() == 0
    sides = {(r.p, r.q): r.group for r in met.collect()}
    assert max(sides.values()) < 400


def test_every_pair_of_components_meets(spark):
    rng = random.Random(3)
    rows = [(k % 2, k, rng.choice([0, 0, 0, 1, 2, 3])) for k in range(400)]
    members = spark.createDataFrame([(g, k, c + 10 * g, b"x") for g, k, c in rows], "key long, id long, component long, signature binary")
    met = set()
    blocks = {}
    for r in minhash._blocks(members, minhash._mixed(members, "key"), "key", 16).collect():
        blocks.setdefault((r.key, r.p, r.q), []).append(r)
    for (_, p, q), own in blocks.items():
        for x in own:
            for y in own:
                if x.own == p and y.own == q:
                    met |= {(x.id, y.id), (y.id, x.id)}
    assert all((a, b) in met for g, a, c in rows for h, b, d in rows if g == h and c != d)


def test_small_sets_that_reach_the_threshold_share_a_key():
    rng = random.Random(4)
    tried = 0
    for _ in range(20_000):
        u = rng.randrange(4, 12)
        every = np.array([rng.getrandbits(64) for _ in range(u)], np.uint64)
        out = rng.sample(range(u), rng.randrange(1, 3))
        side = [rng.random() < 0.5 for _ in out]
        a = np.sort(np.delete(every, [i for i, s in zip(out, side, strict=True) if s]))
        b = np.sort(np.delete(every, [i for i, s in zip(out, side, strict=True) if not s]))
        common = u - len(out)
        if 100 * common >= 75 * u:
            tried += 1
            assert set(minhash.small_keys(a).tolist()) & set(minhash.small_keys(b).tolist()), (len(a), len(b))
    assert tried > 1000


def test_short_texts_against_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 15))]
        texts += [" ".join(words), " ".join(words[1:]), " ".join([*words, "end"]), " ".join(["start", *words])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(part)) and len(set(part)) < len(part)
