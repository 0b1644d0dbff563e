"""The stored inverted file: recall, what it reads, changes, odd rows."""

import re

import numpy as np
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.operators import pq, vectors
from loamstone.sources.tables import load

SCHEMA = "vec_id long, embedding array<float>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def recall(found, exact):
    return vectors.recall(found, exact).agg(F.avg("recall")).first()[0]


def test_recall_and_what_is_read(spark, tmp_path, monkeypatch):
    v = load(spark, data_dir("0.1"), "embeddings")
    q = vectors.query_set(v)
    monkeypatch.setattr(pq, "SHELF_ROWS", 100)
    index = pq.StoredIvf.build(v, f"file://{tmp_path}/i")
    assert index.codes.shelves == 20
    found, exact = index.search(q), vectors.knn_cosine(v, q)
    assert recall(found, exact) >= 0.9
    sims = {(r.query_id, r.vec_id): r.sim for r in exact.collect()}
    assert all(sims.get((r.query_id, r.vec_id), r.sim) == r.sim for r in found.collect())
    lists = [3, 5]
    read = index._read(index._state()[1], lists).select("vec_id", "code")
    assert {re.search(r"shelf=(\d+)", r.f).group(1) for r in read.select(F.input_file_name().alias("f")).distinct().collect()} <= {"3", "5"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
    again = pq.StoredIvf(spark, f"file://{tmp_path}/i")
    assert rows(again.search(q)) == rows(found)


def test_changes(spark, tmp_path, monkeypatch):
    v = load(spark, data_dir("0.01"), "embeddings").select("vec_id", "embedding")
    q = vectors.query_set(v)
    index = pq.StoredIvf.build(v.where("vec_id < 300"), f"file://{tmp_path}/i")
    index.add(v.where("vec_id >= 250"))
    every = dict(nprobe=99, keep=600)
    assert rows(index.search(q, **every)) == rows(vectors.knn_cosine(v, q))
    index.delete(v.where("vec_id % 3 = 0"))
    left = v.where("vec_id % 3 <> 0")
    assert rows(index.search(q, **every)) == rows(vectors.knn_cosine(left, q)) and index._state()[1]["n"] == left.count()
    flipped = left.where("vec_id < 20").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.add(flipped)
    assert rows(index.search(q, **every)) == rows(vectors.knn_cosine(left.where("vec_id >= 20").union(flipped), q))
    one = rows(index.search(q))
    monkeypatch.setattr(pq, "QUERY_BLOCK", 7)
    assert rows(index.search(q)) == one


def test_odd_rows(spark, tmp_path):
    good = [(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(40)]
    odd = [(None, [1.0, 1.0, 1.0]), (50, None), (51, [1.0, None, 1.0]), (52, [float("nan"), 1.0, 1.0]), (53, [1.0]), (54, [float("inf"), 1.0, 1.0]), (55, [0.0, 0.0, 0.0]), (2**53 + 1, [1.0, 1.0, 1.0])]
    index = pq.StoredIvf.build(spark.createDataFrame(good + odd, SCHEMA), f"file://{tmp_path}/i", parts=2)
    got = index.search(spark.createDataFrame([(2**53 + 1, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (7, None)], SCHEMA), 50, nprobe=99, keep=99).collect()
    assert {r.query_id for r in got} == {2**53 + 1} and {r.vec_id for r in got} == {*range(40), 55}
    none = pq.StoredIvf.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert none.search(spark.createDataFrame(good, SCHEMA)).count() == 0


def test_judging_follows_exact_products():
    rng = np.random.default_rng(1)
    x = vectors._unit(rng.standard_normal((4000, 8)))
    codes = pq.Codes(x[:4], [pq._codebook(x[:, s : s + 2] - x[:4][(x @ x[:4].T).argmax(axis=1)][:, s : s + 2], rng) for s in (0, 2, 4, 6)], 4, 1.0)
    home, code = codes.encode(x)
    about = codes.judged(x[:20], 1, code[home == 1])
    assert np.abs(about - x[:20] @ x[home == 1].T).max() < 0.25 and np.abs(about - x[:20] @ x[home == 1].T).mean() < 0.03
