"""Trained embeddings against a dense SVD; stored sketches against exact figures."""

import numpy as np
import pytest
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.operators import lsa, vectors
from loamstone.operators.sketches import SketchStore
from loamstone.sources.tables import load


def dense(texts, features):
    """TF-IDF rows of unit length, by plain numpy."""
    import math
    import re
    import zlib
    from collections import Counter

    rows = [Counter(zlib.crc32(w.encode()) % features for w in re.findall(r"[^\W_]+", t.lower())) for t in texts]
    df = Counter(k for r in rows for k in r)
    a = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        for k, tf in r.items():
            a[i, k] = (1 + math.log(tf)) * math.log(len(rows) / df[k])
        a[i] /= max(np.linalg.norm(a[i]), 1e-300)
    return a


def test_equals_a_dense_svd(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[k % 4], 30)) + " " + " ".join(rng.choice(topics[(k + 1) % 4], 4)) + " common" for k in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, " .,"), (None, "t0w1")], "doc_id long, text string").repartition(5)
    model = lsa.fit(docs.where("doc_id is not null"), 4, rounds=4)
    got = {r.vec_id: r.embedding for r in model.embed(docs).collect()}
    assert sorted(got) == list(range(60))
    a = dense(texts, lsa.FEATURES)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    want = a @ vt[:4].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.array([got[k] for k in range(60)])
    assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-3
    none = lsa.fit(docs.limit(0))
    assert none.axes.shape[1] == 0 and [list(r.embedding) for r in none.embed(docs.where("doc_id = 1")).collect()] == [[]]


def test_finds_texts_by_other_parts_better_than_word_buckets(spark):
    """Words 41 to 80 of every fifth text ask for the text: the mean reciprocal rank of its own id among all of 80 words and more."""
    docs = load(spark, data_dir("0.01"), "documents").where("size(split(text, ' ')) >= 80").select("doc_id", "text")
    asked = docs.where("doc_id % 5 = 0").select("doc_id", F.array_join(F.slice(F.split("text", " "), 41, 40), " ").alias("text"))

    def mrr(embed):
        near = vectors.knn_cosine(embed(docs), embed(asked), 50, skip_self=False)
        return near.where("query_id = vec_id").agg(F.sum(1 / F.col("rank"))).first()[0] / asked.count()

    model = lsa.fit(docs)
    trained, buckets = mrr(model.embed), mrr(vectors.embed_words)
    assert trained > buckets + 0.03 and trained > 0.8, (trained, buckets)


def test_sketches_merge_in_any_order(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 9000).alias("who"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("ts"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("g"), (F.hash("id") % 1000).cast("double").alias("v"))
    stores = [SketchStore(spark, f"file://{tmp_path}/{n}", time_col="ts", group_col="g", id_col="who", value_col="v") for n in "ab"]
    parts = [rows.where(F.col("who") % 4 == k) for k in range(4)]
    for store, order in zip(stores, ([0, 1, 2, 3], [3, 1, 0, 2]), strict=True):
        assert all(store.update(parts[k], f"b{k}") for k in order) and not store.update(parts[0], "b0")
    one, two = ({r.grp: r for r in s.summary("2024-01-05", "2024-01-14").collect()} for s in stores)
    days = rows.where("ts >= '2024-01-05' and ts < '2024-01-15'")
    exact = {r.g: r for r in days.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("who").alias("ids")).collect()}
    assert set(one) == set(exact) == {"x", "y", None}
    for g, r in one.items():
        assert r.n == two[g].n == exact[g].n and r.ids_theta == pytest.approx(two[g].ids_theta, rel=0.05)
        assert abs(r.ids_hll / exact[g].ids - 1) < 0.08 and abs(r.ids_theta / exact[g].ids - 1) < 0.08
        below = days.where(F.col("g").eqNullSafe(F.lit(g)) & (F.col("v") <= r.q1)).count()
        assert abs(below / r.n - 0.9) < 0.03
    both = stores[0].common("2024-01-01", "2024-01-30").collect()
    users = {g: {r.who for r in rows.where(F.col("g") == g).select("who").distinct().collect()} for g in "xy"}
    assert [(r.a, r.b) for r in both] == [("x", "y")] and abs(both[0].ids - len(users["x"] & users["y"])) <= 0.1 * len(users["x"] | users["y"])
    assert SketchStore(spark, f"file://{tmp_path}/none", time_col="ts", group_col="g", id_col="who", value_col="v").summary().count() == 0


def test_products_are_taken_in_pieces(monkeypatch):
    """2,000 rows of 200 features by 74 columns would be 237 MB at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    row, at, w = np.repeat(np.arange(2000), 200), rng.integers(0, 5000, 400_000), rng.random(400_000)
    table = rng.random((5000, 74)).astype(np.float32)
    tracemalloc.start()
    out = lsa._add_products(np.zeros((2000, 74)), row, w, table, at)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert np.allclose(out[1999], w[-200:] @ table[at[-200:]])
    monkeypatch.setattr(lsa.B, "CELLS", 740)
    assert np.allclose(out, lsa._add_products(np.zeros((2000, 74)), row, w, table, at))


def test_batches_are_cut_by_their_lists():
    import pyarrow as pa

    lists = [[1] * k for k in (0, 3, 2, 0, 9, 1, 1, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], names=["id", "w"]).slice(1)
    parts = list(lsa.B.pieces(whole, "w", 5))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(1, 8)) and [p.num_rows for p in parts] == [3, 1, 3]
    assert not list(lsa.B.pieces(whole.slice(7), "w", 5))


def test_figures_of_many_ids_are_exact(spark, tmp_path):
    """7,500 users of two kinds of events, above what a sketch holds."""
    import __spark_entry__ as entry

    e = spark.range(40_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("ts"), (F.col("id") % 9001).alias("user_id"), F.when(F.col("id") % 4 == 0, "x").when(F.col("id") < 30_000, "y").otherwise("z").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    days = e.where("ts >= '2024-01-03' and ts < '2024-01-20'")
    by = {k: {r.user_id for r in days.where(F.col("event_type") == k).select("user_id").distinct().collect()} for k in "xyz"}
    queries, n = entry.queries(), {r.event_type: r["count"] for r in days.groupBy("event_type").count().collect()}
    assert {r.grp: (r.n, r.users) for r in queries["agg_sketches"](spark, f"file://{tmp_path}").collect()} == {k: (n[k], len(by[k])) for k in "xyz"}
    got = {(r.a, r.b): r.ids for r in queries["agg_sketch_overlap"](spark, f"file://{tmp_path}").collect()}
    assert got == {p: len(by[p[0]] & by[p[1]]) for p in (("x", "y"), ("x", "z"), ("y", "z"))} and max(map(len, by.values())) > 4096
