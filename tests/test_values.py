"""Values of operators without SQL, against plain Python."""

import numpy as np
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.operators import ranking, vectors
from loamstone.queries import retrieval
from loamstone.sources.tables import load


def test_marginal_relevance_is_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(q, d, float(rng.integers(0, 5)) / 4, rng.standard_normal(4).tolist()) for q in range(4) for d in range(12)]
    rows += [(9, 1, 0.5, [1.0, 0.0, 0.0, 0.0]), (9, 2, 0.5, [1.0, 0.0, 0.0, 0.0])]
    got = ranking.rerank_mmr(spark.createDataFrame(rows, "query_id long, doc_id long, score double, embedding array<double>"), 5, 0.6)
    want = set()
    for q in {r[0] for r in rows}:
        left = {d: (s, np.array(v) / np.linalg.norm(v)) for a, d, s, v in rows if a == q}
        taken = []
        while left and len(taken) < 5:
            value = lambda d: 0.6 * left[d][0] - 0.4 * max((float(left[d][1] @ v) for _, v in taken), default=0.0)  # noqa: E731, B023
            best = max(sorted(left, key=lambda d: (-left[d][0], d)), key=lambda d: round(value(d), 12))
            taken.append((best, left.pop(best)[1]))
        want |= {(q, d, k) for k, (d, _) in enumerate(taken, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_embeddings_of_the_callers_model(spark):
    docs = load(spark, data_dir("0.001"), "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in retrieval.embed_model(spark, data_dir("0.001")).collect():
        b = (texts[r.doc_id] or "").lower().encode()
        assert np.allclose(r.embedding, [b.count(c) / max(len(b), 1) for c in range(97, 123)], atol=1e-6)


def test_recall_counts_what_both_found(spark):
    hits = lambda pairs: spark.createDataFrame(pairs, "query_id long, vec_id long")
    got = vectors.recall(hits([(1, 1), (1, 2), (2, 9), (3, 1)]), hits([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]))
    assert {r.query_id: r.recall for r in got.collect()} == {1: 0.5, 2: 0.0}
    d = data_dir("0.01")
    v = load(spark, d, "embeddings")
    exact = {}
    for r in vectors.knn_cosine(v, vectors.query_set(v)).collect():
        exact.setdefault(r.query_id, set()).add(r.vec_id)
    found = {}
    for r in retrieval.ann_ivf(spark, d).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert {r.query_id: round(r.recall * 10) for r in retrieval.ann_recall(spark, d).collect()} == {q: len(s & found.get(q, set())) for q, s in exact.items()}


def test_hashed_tfidf(spark):
    rows = {r.doc_id: np.array(r.embedding) for r in retrieval.embed_text(spark, data_dir("0.001")).collect()}
    sizes = load(spark, data_dir("0.001"), "documents").select("doc_id", F.size(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("n")).collect()
    assert all(abs(np.linalg.norm(rows[r.doc_id]) - 1) < 1e-5 for r in sizes if r.n > 3)
