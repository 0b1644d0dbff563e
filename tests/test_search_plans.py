"""Larger query sets take other plans with the same results; approximate search finds what it says."""

import numpy as np
import pyarrow as pa
import pytest
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.operators import lexical, vectors
from loamstone.sources import connectors
from loamstone.sources.tables import load, small_enough
from loamstone.streaming import events as E
from loamstone.streaming import index


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rank", [lexical.bm25_topk, lexical.tfidf_topk])
def test_keyword_plans_agree(spark, monkeypatch, rank):
    docs, bench = load(spark, data_dir("0.001"), "documents"), load(spark, data_dir("0.001"), "benchmark")
    one = rows(rank(docs, bench, 7))
    monkeypatch.setattr(lexical, "SCORE_CELLS", 200)
    small = rows(rank(docs, bench, 7))
    monkeypatch.setattr(lexical, "TERMS", 5)
    joined = rows(rank(docs, bench, 7))
    assert one == small == joined and len(one) > 200


def test_keyword_search_without_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    asked = spark.createDataFrame([(1, "b zz"), (2, "zz"), (3, None)], "item_id long, text string")
    assert lexical.bm25_topk(docs, none).count() == 0 and lexical.bm25_topk(docs.limit(0), asked).count() == 0
    assert [(r.query_id, r.doc_id, r.rank) for r in lexical.bm25_topk(docs, asked).collect()] == [(1, 3, 1)]


def test_vector_blocks_agree(spark):
    v = load(spark, data_dir("0.01"), "embeddings")
    q = vectors.query_set(v, 5)
    assert q.count() == 100
    whole = rows(vectors.knn_cosine(v, q, 10))
    assert whole == rows(vectors.knn_cosine(v, q, 10, query_block=30, vector_block=170)) and len(whole) == 1000
    near = rows(vectors.knn_threshold(v, q, 0.25))
    blocks = vectors._hits(v, q, lambda n: vectors._Above(0.25), query_block=30, vector_block=170)
    assert near == rows(blocks) and near
    assert vectors.knn_cosine(v, q.limit(0), 10).count() == 0


def test_few_pairs_are_ranked_by_built_in_functions(spark, monkeypatch):
    v = load(spark, data_dir("0.1"), "embeddings")
    q, ranked, top = vectors.query_set(v), [], vectors.top
    monkeypatch.setattr(vectors, "top", lambda hits, k: ranked.append(hits) or top(hits, k))
    found = rows(vectors.knn_sql(v, q, 5))
    assert sum(h.count() for h in ranked) < v.count() * q.count() / 5
    monkeypatch.undo()
    assert found == rows(vectors.knn_cosine(v, q, 5)) and len(found) == 500


@pytest.mark.parametrize("shape", [{}, {"query_block": 7, "pairs": 500}])
def test_copies_and_vectors_without_length_by_built_in_functions(spark, shape):
    """400 copies of one vector, 100 times its double, zeros, nulls and 300 others; the k best of many equal ones are those of the smallest ids."""
    x = np.random.default_rng(3).normal(size=(300, 6)).round(3).tolist()
    all_of = [x[0]] * 400 + [[2 * y for y in x[0]]] * 100 + [[0.0] * 6] * 9 + x
    v = spark.createDataFrame([((i * 7919) % 1009, e) for i, e in enumerate(all_of)], "vec_id long, embedding array<float>")
    q = vectors.query_set(v)
    got = rows(vectors.knn_sql(v, q, 4, **shape))
    assert got == rows(vectors.knn_cosine(v, q, 4)) and len(got) == 4 * q.count()
    none = spark.createDataFrame([(5000, None), (5001, [1.0, None] + [0.0] * 4)], v.schema)
    assert got == rows(vectors.knn_sql(v.union(none), q, 4, **shape))
    assert vectors.knn_sql(v.limit(0), q).count() == vectors.knn_sql(v, q.limit(0)).count() == 0
    assert vectors.knn_sql(v.limit(3), v.limit(3), 9).count() == 6


def test_wide_odd_and_repeated_vectors_by_built_in_functions(spark):
    x = np.random.default_rng(5).normal(size=(300, 131)).round(3).tolist()
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    q = vectors.query_set(v)
    exact = rows(vectors.knn_cosine(v, q, 4))
    assert rows(vectors.knn_sql(v, q, 4)) == exact
    twice = rows(vectors.knn_sql(v.union(v), q, 8).select("query_id", "vec_id", "sim"))
    assert twice == sorted(r[:3] for r in exact for _ in range(2))
    odd = spark.createDataFrame([(1001, [float("nan")] * 131)], v.schema)
    assert [r[1] for r in rows(vectors.knn_sql(v.union(odd), q, 1))] == [1001] * q.count()


def test_ragged_vectors_raise(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="hasn't 2 entries"):
        vectors.knn_sql(v, vectors.query_set(v), 1).collect()


@pytest.mark.parametrize("find", [lambda v, q: vectors.IvfIndex(v).search(q), vectors.ann_lsh])
def test_recall_at_the_larger_scale(spark, find):
    v = load(spark, data_dir("0.1"), "embeddings")
    q = vectors.query_set(v)
    got = vectors.recall(find(v, q), vectors.knn_cosine(v, q)).agg(F.avg("recall")).first()[0]
    assert got >= 0.9


def test_many_queries_of_an_inverted_file(spark, monkeypatch):
    v = load(spark, data_dir("0.01"), "embeddings")
    q = vectors.query_set(v)
    made = vectors.IvfIndex(v)
    one = rows(made.search(q))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    assert rows(made.search(q)) == one


def test_shape_of_hashing_follows_the_rows():
    sims = np.full((50, 10), 0.8)
    shapes = [vectors.lsh_shape(n, sims, 0.95) for n in (1_000, 100_000, 100_000_000)]
    assert [b for b, _ in shapes] == sorted(b for b, _ in shapes) and shapes[0][0] < shapes[2][0]
    for bits, tables in shapes:
        assert 1 - (1 - (1 - np.arccos(0.8) / np.pi) ** bits) ** tables >= 0.95


def test_hashing_says_when_it_misses_its_target():
    with pytest.warns(UserWarning, match="not 0.99"):
        vectors.lsh_shape(1000, np.full((5, 5), -0.9), 0.99)


def test_writers_of_a_key_follow_its_rows(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, "hot").when(F.col("id") < 2990, None).otherwise("rare").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    try:
        connectors.write_partitioned(df, f"file://{tmp_path}/t", "k", rows_a_file=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert files["k=rare"] == 1 and files["k=__HIVE_DEFAULT_PARTITION__"] == 1 and files["k=hot"] > 4
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3000


def test_index_after_updates(spark, tmp_path):
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "doc_id long, text string, v int, gone boolean"
    steps = [[(1, "one", 1, False), (2, "two", 1, False), (3, "three", 1, False), (4, "four", 1, None)], [(1, "", 2, False), (2, "a much longer stale text", 2, False), (2, "new", 3, False), (3, "three", 2, True)], [(3, "back", 3, False), (5, None, 1, False)]]
    want = [{1: "one", 2: "two", 3: "three", 4: "four"}, {2: "new", 4: "four"}, {2: "new", 3: "back", 4: "four"}]
    for rows_, held in zip(steps, want, strict=True):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
        index.stream_index(E.stream_files(spark, path, schema), out, order=F.col("v"), deleted=F.col("gone"))
        assert {r.doc_id: r.chunk_text for r in index.current(spark, out).collect()} == held
    spark.createDataFrame([(k, "all new", 9, False) for k in range(1, 6)], schema).coalesce(1).write.mode("append").parquet(path)
    index.stream_index(E.stream_files(spark, path, schema), out, order=F.col("v"), deleted=F.col("gone"))
    assert index.vacuum(spark, out) == 3 and {r.chunk_text for r in index.current(spark, out).collect()} == {"all new"} and index.vacuum(spark, out) == 0


def test_late_rows_are_routed_batch_by_batch(spark, tmp_path):
    path, schema = f"file://{tmp_path}/in", "event_id long, ts timestamp_ntz"
    day = "2024-01-01 "
    for part in ([(1, "10:00"), (2, "09:00")], [(3, "10:30"), (4, "09:55"), (5, "09:49")], [(6, "10:20"), (7, "10:19"), (8, "10:25")]):
        spark.createDataFrame([(k, day + t) for k, t in part], "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) ts").coalesce(1).write.mode("append").parquet(path)
    timely, late = E.route_late(E.stream_files(spark, path, schema), f"file://{tmp_path}/out")
    assert sorted(r.event_id for r in late.collect()) == [5, 7]
    assert sorted(r.event_id for r in timely.collect()) == [1, 2, 3, 4, 6, 8]


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    wide = spark.range(100).select("id", F.lit("x" * 1000).alias("s"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"), F.struct(F.lit("y" * 50).alias("t")).alias("z"))
    assert small_enough(wide, 100, 200_000) and not small_enough(wide, 99) and not small_enough(wide, 100, 100_000)
    assert small_enough(wide.limit(0), 0, 0)


@pytest.mark.parametrize("find", [lambda v, q: vectors.IvfIndex(v).search(q), vectors.ann_lsh])
def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch, find):
    """Candidates aren't joined pair by pair, and blocks change no result."""
    v = load(spark, data_dir("0.01"), "embeddings")
    q = vectors.query_set(v)
    one = rows(find(v, q))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    many = find(v, q)
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert rows(many) == one and one


def test_comparisons_are_bounded_in_memory():
    """4,096 queries against a batch of 10,000 vectors would be 328 MB a matrix."""
    import tracemalloc

    rng = np.random.default_rng(1)
    ids, unit = np.arange(4096), vectors._unit(rng.standard_normal((4096, 16)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rng.standard_normal((10_000, 16)).astype(np.float32)), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    keep = vectors.Best(4096, 10)
    tracemalloc.start()
    vectors._exact(True)(ids, unit)(batch, keep)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250e6
    sim, other = vectors._compared(ids[:5], unit[:5], batch, True)
    got = keep.batch(ids).to_pandas()
    for i in range(5):
        want = np.lexsort((other, -sim[i]))[:10]
        assert got[got.query_id == i].sort_values(["sim", "vec_id"], ascending=[False, True]).vec_id.tolist() == other[want].tolist()


def test_words_of_a_phrase_are_split_out_once_a_text(spark):
    """A text of 40,000 words; splitting it at every place takes hours."""
    import time

    docs = spark.createDataFrame([(1, "of the and " * 13_000 + "Of the"), (2, None), (3, "of"), (4, "the of"), (5, "of, THE of the often the")], "doc_id long, text string")
    start = time.time()
    assert {r.doc_id: r.n for r in lexical.phrase_match(docs, "of the").collect()} == {1: 13_001, 5: 2}
    assert {r.doc_id: r.n for r in lexical.phrase_match(spark.createDataFrame([(1, "a a a")], "doc_id long, text string"), "a a").collect()} == {1: 2}
    assert time.time() - start < 60


def test_writers_of_a_key_follow_its_bytes(spark, tmp_path):
    df = spark.range(200).select("id", F.lit("hot").alias("k"), F.repeat(F.lit("x"), 10_000).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        connectors.write_partitioned(df, f"file://{tmp_path}/t", "k", bytes_a_file=100_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "k=hot").glob("*.parquet"))) > 4 and spark.read.parquet(f"file://{tmp_path}/t").count() == 200


def test_files_of_a_stream_follow_its_bytes(spark):
    from loamstone.queries.streams import _files

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    assert _files(df) == 4 and _files(df, 100_000) >= 10 and _files(df.limit(0)) == 4
