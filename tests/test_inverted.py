"""The stored index against plain search: additions, replacements, deletions, merges; what it reads; phrases."""

import re

import numpy as np
import pytest
from harness import data_dir
from pyspark.sql import functions as F

from loamstone.functions.text import tokenize
from loamstone.operators import inverted, lexical
from loamstone.operators.inverted import InvertedIndex
from loamstone.sources.manifest import Manifest, Store
from loamstone.sources.tables import load


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(inverted, "RANGE_DOCS", 60)
    monkeypatch.setattr(inverted, "BLOCK", 4)
    monkeypatch.setattr(inverted, "FEW", 10)
    monkeypatch.setattr(inverted, "BUCKETS", 8)


def test_changes_follow_a_fresh_search(spark, tmp_path, small_ranges):
    docs, bench = load(spark, data_dir("0.001"), "documents").select("doc_id", "text"), load(spark, data_dir("0.001"), "benchmark")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    assert index.bm25(bench).count() == 0 and not index.merge()
    index.add(docs.where("doc_id % 3 = 0"))
    index.add(docs.where("doc_id % 3 <> 0"))

    def same(held):
        assert rows(index.bm25(bench, 7)) == rows(lexical.bm25_topk(held, bench, 7))

    same(docs)
    assert rows(index.tfidf(bench)) == rows(lexical.tfidf_topk(docs, bench))
    index.delete(docs.where("doc_id % 7 = 1"))
    held = docs.where("doc_id % 7 <> 1")
    same(held)
    changed = held.where("doc_id % 5 = 2").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" the new other words"))))
    index.add(changed)
    held = held.where("doc_id % 5 <> 2").unionByName(changed)
    same(held)
    assert index.merge() and len(index._state()[1]["segments"]) == 1 and not index._state()[1]["gone"]
    same(held)
    assert len(index.manifest.store.names("segments")) == 1 and index.manifest.store.names("gone") == []


def test_odd_rows(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a b c"), (2**53 + 1, "a a"), (None, "a b"), (3, None), (4, ""), (-5, "c"), (2**63 - 1, "b"), (-(2**63), "b b")], schema)
    asked = spark.createDataFrame([(2**53 + 1, "a"), (None, "a"), (1, None), (2, "zz"), (3, "B c"), (3, "b")], "item_id long, text string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    want = rows(lexical.bm25_topk(docs, asked, 9))
    assert rows(index.bm25(asked, 9)) == want
    assert [(q, d) for q, d, _, _ in want if q != 3] == [(2**53 + 1, 1), (2**53 + 1, 2**53 + 1)] and {d for q, d, _, _ in want if q == 3} == {1, -5, 2**63 - 1, -(2**63)}
    with pytest.raises(ValueError):
        index.add(docs.union(docs.where("doc_id = 1")))
    monkeypatch.setattr(inverted, "TERMS", 2)  # a larger query set is searched in parts
    assert rows(index.bm25(asked, 9)) == want
    with pytest.raises(ValueError):
        index.bm25(asked.withColumn("item_id", F.lit(1)))


def test_null_ids_in_both_keyword_plans(spark, monkeypatch):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, "a"), (7, "a c"), (7, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(None, "a"), (2**53 + 1, "a"), (5, "b")], "item_id long, text string")
    for rank in (lexical.bm25_topk, lexical.tfidf_topk):
        monkeypatch.setattr(lexical, "TERMS", 500_000)
        one = rows(rank(docs, asked))
        monkeypatch.setattr(lexical, "TERMS", 0)
        assert rows(rank(docs, asked)) == one and {(q, d) for q, d, _, _ in one} == {(2**53 + 1, 2**53 + 1), (2**53 + 1, 7), (5, 2**53 + 1)}


def test_reads_only_the_buckets_of_its_words(spark, tmp_path):
    docs = load(spark, data_dir("0.001"), "documents")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    terms = spark.createDataFrame([("the",), ("of",)], "term string")
    read = index._read(index._state()[1], ["term", "n"], terms)
    files = [re.search(r"bucket=(\d+)", f).group(1) for f in read.inputFiles()]
    assert read.count() and len(set(files)) > 2  # inputFiles lists the folder whole; the plan prunes it
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan and "gaps" not in plan.split("ReadSchema")[1]
    buckets = {r.bucket for r in terms.select(inverted.bucket_of().alias("bucket")).collect()}
    seen = {re.search(r"bucket=(\d+)", r.f).group(1) for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert seen == {str(b) for b in buckets}


def test_blocks_under_the_bound_are_not_scored(spark, tmp_path, monkeypatch):
    """A word of every document, and a few documents where it is frequent: their blocks alone are scored."""
    monkeypatch.setattr(inverted, "FEW", 10)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common"), F.when(F.col("id") % 3331 == 5, " common common common").otherwise(F.concat(F.lit(" filler w"), F.col("id")))).alias("text"))
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    asked = spark.createDataFrame([(1, "common")], "item_id long, text string")
    assert rows(index.bm25(asked, 2)) == rows(lexical.bm25_topk(docs, asked, 2))
    assert index.read.value > 200 and index.scored.value < index.read.value / 4


def test_windows_equal_scoring_everything(monkeypatch):
    """Random blocks of one range: the k best by windows are those of all."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    monkeypatch.setattr(inverted, "FEW", 0)
    for trial in range(30):
        parts, term = [], []
        for t in range(rng.integers(1, 5)):
            ids = np.sort(rng.choice(3000, rng.integers(1, 900), replace=False))
            tf, size = rng.integers(1, 6, len(ids)), rng.integers(6, 50, len(ids))
            for s in range(0, len(ids), 16):
                i, f, z = ids[s : s + 16], tf[s : s + 16], size[s : s + 16]
                best = {int(a): int(z[f == a].min()) for a in f}
                parts.append((int(i[0]), len(i), np.diff(i, prepend=i[:1]).tolist(), f.tolist(), z.tolist(), list(best), list(best.values())))
                term.append(t)
        names = ["first", "n", "gaps", "tfs", "lens", "best_tf", "best_len"]
        order = rng.permutation(len(parts))
        table = pa.Table.from_pydict({c: [parts[k][j] for k in order] for j, c in enumerate(names)}, schema=pa.schema([(c, pa.int64() if j < 2 else pa.list_(pa.int64())) for j, c in enumerate(names)]))
        gone = rng.choice(3000, 200)
        part = inverted._Range(table, np.array(term)[order], gone)
        weigh = lambda t, f, z: (t + 1) * f / (f + 0.1 * z)
        blocks = np.arange(len(part.term))
        doc, score = part.scores(blocks, weigh)
        want = sorted(zip(-np.round(score, 6), doc, strict=True))[:10]
        doc, score, n = inverted.best_of_range(part, blocks, part.bounds(weigh), weigh, 10, -np.inf)
        assert sorted(zip(-score, doc, strict=True))[:10] == want and n <= len(blocks) and not set(doc) & set(gone)


def test_phrases(spark, tmp_path, small_ranges):
    docs = spark.createDataFrame([(1, "New York, new york new"), (2, "york new"), (3, "a a a a"), (4, "b a"), (5, None), (None, "new york")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "new york"), (2, "York New"), (3, "a a"), (4, "a"), (5, "a b"), (6, ""), (None, "a"), (7, "new york new york"), (8, "new york")], "item_id long, text string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    assert rows(index.phrases(asked)) == [(1, 1, 2), (2, 1, 2), (2, 2, 1), (3, 3, 3), (4, 3, 4), (4, 4, 1), (7, 1, 1), (8, 1, 2)]
    index.delete(docs.where("doc_id = 1"))
    assert rows(index.phrases(asked)) == [(2, 2, 1), (3, 3, 3), (4, 3, 4), (4, 4, 1)]
    large = load(spark, data_dir("0.001"), "documents")
    index.add(large.withColumn("doc_id", F.col("doc_id") + 100))
    for words in ("of the", "on the"):
        want = {(r.doc_id + 100, r.n) for r in lexical.phrase_match(large, words).collect()}
        assert {(r.doc_id, r.n) for r in index.phrases(spark.createDataFrame([(1, words)], "item_id long, text string")).collect()} == want


def test_postings_travel_by_bucket_and_range(spark, tmp_path, monkeypatch):
    """Additions and merges deal a row for each bucket and range of a million words, not one for each word of each document."""
    dealt, real = [], inverted._blocks

    def counted(rows_of_words, files):
        dealt.append(rows_of_words.count())
        return real(rows_of_words, files)

    monkeypatch.setattr(inverted, "_blocks", counted)
    docs = load(spark, data_dir("0.001"), "documents").select("doc_id", "text")
    postings = lexical.postings(docs).count()
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    index.delete(docs.where("doc_id % 7 = 1"))
    assert index.merge()
    assert len(dealt) == 2 and all(0 < n < postings / 20 for n in dealt), (dealt, postings)


@pytest.mark.parametrize("most", [1, 700])
def test_texts_in_pieces_and_any_order(spark, tmp_path, monkeypatch, small_ranges, most):
    """Ids that come mixed, in pieces of a few words put in order in several turns: the same hits, positions and lengths, also once merged."""
    monkeypatch.setattr(inverted, "WORDS", most)
    monkeypatch.setattr(inverted, "MOST_PLACES", 3 * most)
    docs = load(spark, data_dir("0.001"), "documents").select(((F.col("doc_id") * 7919) % 10_007 - 5_000).alias("doc_id"), F.substring("text", 1, 400).alias("text")).repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(2**63 - 1, "of the été of the"), (-(2**63), "of the 数 of"), (2**53 + 1, "")], "doc_id long, text string")).localCheckpoint()
    bench = load(spark, data_dir("0.001"), "benchmark").unionByName(spark.createDataFrame([(-1, "été 数 the")], "item_id long, text string"))
    asked = spark.createDataFrame([(1, "of the")], "item_id long, text string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)

    def same(held):
        assert rows(index.bm25(bench, 7)) == rows(lexical.bm25_topk(held, bench, 7))
        assert {(r.doc_id, r.n) for r in index.phrases(asked).collect()} == {(r.doc_id, r.n) for r in lexical.phrase_match(held, "of the").collect()}
        state = index._state()[1]
        assert rows(index._docs(state).select("doc_id", "len")) == rows(held.select("doc_id", F.size(tokenize("text")).alias("len")).where("len > 0"))

    same(docs)
    index.delete(docs.where("doc_id % 3 = 0"))
    held = docs.where("doc_id % 3 <> 0")
    same(held)
    assert index.merge()
    same(held)
    assert index.merge() and index.merge()
    same(held)


def test_order_by_two_keys():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(-50, 50, 999), rng.integers(-(2**63), 2**63 - 1, 999), np.array([2**63 - 1, -(2**63), 0])):
        words = rng.integers(0, 9, len(ids))
        order = inverted._sorted(words, ids)
        assert sorted(order.tolist()) == list(range(len(ids))) and list(zip(words[order], ids[order], strict=True)) == sorted(zip(words, ids, strict=True))


def test_words_are_in_the_buckets_they_are_looked_for_in(spark, tmp_path):
    import pyarrow as pa

    words = ["a", "été", "数", "x" * 70, "1", "ß"]
    want = [r.b for r in spark.createDataFrame([(w,) for w in words], "term string").select(inverted.bucket_of().alias("b")).collect()]
    assert inverted._buckets(pa.array(words), inverted.BUCKETS).tolist() == want
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.manifest.publish(1, {"segments": [], "gone": [], "docs": 0, "words": 0})  # of before, when another hash dealt the words
    with pytest.raises(ValueError):
        index.merge()


def test_a_version_has_one_writer(spark, tmp_path, monkeypatch):
    one = Manifest(spark, f"file://{tmp_path}/m")
    assert one.last() == (0, {}) and one.publish(1, {"a": 1}) and not one.publish(1, {"a": 2}) and one.last() == (1, {"a": 1})
    real = Store._put

    def lost(self, part, to):
        real(self, part, to)
        raise OSError("the reply is lost")

    monkeypatch.setattr(Store, "_put", lost)
    assert one.publish(2, {"a": 3}) and one.last() == (2, {"a": 3})  # its own file, whatever the reply
    assert not one.publish(2, {"a": 3})  # another writer's, though it says the same
    monkeypatch.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("nothing done")))
    with pytest.raises(OSError):
        one.publish(3, {})
    monkeypatch.setattr(Store, "_put", real)
    for v in range(3, 40):
        assert one.publish(v, {"v": v})
    assert one.last() == (39, {"v": 39}) and len(one.store.names("versions")) == 20
