"""Operators on small tables with answers worked out by hand, and their invariants."""

import numpy as np
import pytest
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.functions.text import html_to_text, normalize_ws, tokenize, url_canonical
from loamstone.operators import chunking, lexical, ranking, vectors
from loamstone.sources import connectors
from loamstone.sources.tables import broadcast_if_small, load, load_pruned


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "The cat sat. The dog ran!\n\nEnd of it"), (2, "cat cat bird"), (3, ""), (4, None)], "doc_id long, text string")


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>A &amp;lt; b</p><script>x</script><!-- c --> d\t\n e",)], "h string")
    assert df.select(html_to_text("h")).first()[0] == "A &lt; b d e"
    assert df.select(normalize_ws(F.lit("  Ab \n c "))).first()[0] == "ab c"
    assert df.select(tokenize(F.lit("L'Été x2, y"))).first()[0] == ["l", "été", "x2", "y"]
    assert df.select(url_canonical(F.lit("HTTP://Ex.COM/Path?utm_source=a&b=1&gclid=2#f"))).first()[0] == "http://ex.com/Path?b=1"
    assert df.select(url_canonical(F.lit("http://a/?utm_x=1"))).first()[0] == "http://a/"


def test_chunks_rejoin_to_the_text(spark):
    docs = load(spark, data_dir("0.001"), "documents")
    size, overlap = 120, 20
    rows = chunking.chunk_chars(docs, size, overlap).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_no)):
        assert r.end - r.start == len(r.chunk_text)
        t = by.get(r.doc_id, "")
        by[r.doc_id] = t[: r.start] + r.chunk_text
    assert by == {r.doc_id: r.text for r in docs.collect()}


def test_sentence_packing(docs):
    rows = chunking.chunk_sentences(docs, 14).where("doc_id = 1").orderBy("chunk_no").collect()
    assert [r.chunk_text for r in rows] == ["The cat sat.", "The dog ran!", "End of it"]
    whole = chunking.chunk_sentences(docs, 100).where("doc_id = 1").collect()
    assert [r.chunk_text for r in whole] == ["The cat sat. The dog ran! End of it"]
    assert chunking.chunk_sentences(docs).where("doc_id > 2").count() == 0


def test_keyword_ranking(spark, docs):
    asked = spark.createDataFrame([(9, "cat"), (8, "nothing here")], "item_id long, text string")
    hits = lexical.bm25_topk(docs, asked, 5).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(9, 2, 1), (9, 1, 2)]
    assert [r.doc_id for r in lexical.phrase_match(docs, "cat cat").collect()] == [2]
    assert [r.doc_id for r in lexical.boolean_match(docs, ["cat"], ["bird"]).collect()] == [1]


@pytest.fixture(scope="module")
def vecs(spark):
    return load(spark, data_dir("0.01"), "embeddings")


def test_exact_search_agrees_with_sql_form(vecs):
    q = vectors.query_set(vecs)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(vectors.knn_cosine(vecs, q, 5)) == key(vectors.knn_sql(vecs, q, 5))


@pytest.mark.parametrize("find", [lambda v, q: vectors.IvfIndex(v).search(q), vectors.ann_lsh])
def test_recall_of_approximate_search(vecs, find):
    q = vectors.query_set(vecs)
    got = vectors.recall(find(vecs, q), vectors.knn_cosine(vecs, q)).agg(F.avg("recall")).first()[0]
    assert got >= 0.9


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    one, two = (sorted(map(tuple, ranking.hybrid_rrf(x).collect())) for x in ([a, b], [b, a]))
    assert one == two and max(one, key=lambda r: r[2])[1] == 11


def test_mmr_prefers_what_is_new(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.9, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, score double, embedding array<double>")
    got = ranking.rerank_mmr(hits, 2, trade=0.5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 2), (1, 3, 1, 2), (2, 1, 0, 0)], "query_id long, rank int, rel int, n_relevant long")
    got = {r.query_id: r for r in ranking.evaluate(hits, 3).collect()}
    ideal, gain = 1 + 1 / np.log2(3), 1 / np.log2(3) + 1 / 2
    assert got[1].precision == pytest.approx(2 / 3) and got[1].recall == 1 and got[1].mrr == 0.5 and got[1].ndcg == pytest.approx(gain / ideal)
    assert (got[2].precision, got[2].recall, got[2].mrr, got[2].hit, got[2].ndcg) == (0, 0, 0, 0, 0)


def test_budget_is_kept_in_rank_order(spark):
    r = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 10)], "query_id long, rank int, size int")
    assert [x["rank"] for x in ranking.context_pack(r, 110).collect()] == [1, 2]


def test_upsert_keeps_the_later_version(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, v long, x string")
    new = spark.createDataFrame([(1, 2, "A"), (2, 4, "B"), (3, 1, "C")], "k long, v long, x string")
    assert sorted(r.x for r in connectors.upsert(old, new, "k", "v").collect()) == ["A", "C", "b"]


def test_filters_and_columns_reach_the_scan(spark):
    df = load_pruned(spark, data_dir("0.001"), "documents", ["doc_id"], (F.col("lang") == "en") & (F.col("n_chars") > 30))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,30)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_broadcast_only_behind_a_size_check(spark):
    df = spark.range(100)
    broadcast = lambda most: "broadcast" in spark.range(10**6).join(broadcast_if_small(df, most), "id")._jdf.queryExecution().logical().toString().lower()
    assert broadcast(100) and not broadcast(99)


def test_all_character_references(spark):
    import html

    from loamstone.functions.text import unescape_all

    texts = ["&eacute;&#233;&#xE9; &amp;amp; &notit; &nbsp;x &lt;b&gt; &unknown; & &#0; &#x110000; &copy2024 &", "plain", "", None]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(unescape_all("text").alias("t")).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_row_group_source(spark, tmp_path):
    from loamstone.sources import connectors

    connectors.register(spark)
    spark.range(1000).selectExpr("id", "id * 2 AS v", "cast(id as string) AS s").repartition(3).write.option("parquet.block.size", 1024).parquet(f"file://{tmp_path}/t")
    df = spark.read.format("row_groups").schema("v long, id long").option("path", f"file://{tmp_path}/t").load()
    assert sorted(map(tuple, df.collect())) == [(2 * k, k) for k in range(1000)] and df.rdd.getNumPartitions() >= 3


def test_scratch_folders_are_released(spark):
    from loamstone.sources import tables

    one, two = tables.scratch(spark, "a"), tables.scratch(spark, "b")
    for p in (one, two):
        spark.range(3).write.parquet(p)
    assert tables.release(spark, keep=(two,)) >= 1 and spark.read.parquet(two).count() == 3
    try:
        spark.read.parquet(one)
        raise AssertionError("still there")
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)
    assert tables.release(spark) == 1
