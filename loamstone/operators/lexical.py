"""Inverted index and keyword ranking.

Ranked hits are (query_id, doc_id, score, rank). Queries are a stated set. If it has
TERMS words at most, by a count, they go to where the documents are: one pass over the
texts counts the queries' own words in each document's own row and keeps these counts;
document frequencies and lengths are sums over them; then every task scores its
documents and keeps the k best of each query. What is shuffled is queries x tasks x k.
Larger sets are joined to the postings by shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions.text import tokenize
from loamstone.operators.batches import pieces
from loamstone.operators.vectors import Best
from loamstone.sources.tables import broadcast_if_small, scratch, small_enough

SCORE_DIGITS = 6
#: Words of a query set that are broadcast (half a million: some 10 MB), and hits scored at once.
TERMS, SCORE_CELLS = 500_000, 4_000_000


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """term, doc_id, tf."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokenize("text")).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_freq(post: DataFrame) -> DataFrame:
    """term, df."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, len: documents with a word at least."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokenize("text")).cast("long").alias("len")).where("len > 0")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: distinct; queries without an id are left out."""
    return queries.where("item_id is not null").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokenize("text"))).alias("term")).distinct()


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query; ties go to the smaller id. Spark cuts each task's rows to k first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _matched(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the queries' own terms, filtered before the first shuffle."""
    wanted = broadcast_if_small(terms.select("term").distinct())
    words = docs.select("doc_id", F.explode(tokenize("text")).alias("term")).join(wanted, "term", "left_semi")
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def _summed(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Weights (term, doc_id, w) joined to the queries that hold the term; a frequent term's side is one Spark can split."""
    hits = weights.join(broadcast_if_small(terms), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score"))
    return ranked(hits, k)


@dataclass
class _Queries:
    """The distinct words of a query set, and for each word (from ptr[t] to ptr[t + 1]) the numbers of the queries that hold it."""

    ids: np.ndarray
    words: list[str]
    ptr: np.ndarray
    of: np.ndarray


def _query_index(terms: DataFrame) -> _Queries:
    got = terms.toArrow()
    ids, q = np.unique(got.column("query_id").to_numpy(), return_inverse=True)
    coded = got.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    t = coded.indices.to_numpy()
    order = np.argsort(t, kind="stable")
    return _Queries(ids, coded.dictionary.to_pylist(), np.searchsorted(t[order], np.arange(len(coded.dictionary) + 1)), q[order].astype(np.int64))


def _own_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, len, t, tf: every document with a word at least, its length, and numbers and counts of the given words in it."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.string())
        for batch in (piece for whole in batches for piece in pieces(whole, "w")):
            lists, n = batch.column("w"), max(len(wanted), 1)
            size = np.diff(lists.offsets.to_numpy())
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            key, tf = np.unique(row[at >= 0] * n + at[at >= 0], return_counts=True)
            cut = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array((key % n).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))], names=["doc_id", "len", "t", "tf"])

    split = docs.select("doc_id", tokenize("text").alias("w")).where("size(w) > 0")
    return split.mapInArrow(run, "doc_id long, len long, t array<int>, tf array<int>")


def _scored(counts: DataFrame, queries: _Queries, k: int, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, vec_id (the document), sim (the score): the k best of each task. weigh: words' numbers, counts and documents' lengths -> weights."""
    held = counts.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        n = len(q.ids)
        if not n:
            return
        keep = Best(n, k)
        for whole in batches:
            t, tf = (whole.column(c).flatten().to_numpy() for c in ("t", "tf"))
            row = np.repeat(np.arange(whole.num_rows), np.diff(whole.column("t").offsets.to_numpy()))
            many = q.ptr[t + 1] - q.ptr[t]
            w, ids = weigh(t, tf, whole.column("len").to_numpy()[row]), whole.column("doc_id").to_numpy()
            # Documents are taken together until their hits, a query's word in a document each, are SCORE_CELLS.
            group = np.cumsum(np.bincount(row, many, whole.num_rows)) // SCORE_CELLS
            cut = np.searchsorted(group[row], np.unique(group))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
                m = many[s:e]
                at = np.repeat(q.ptr[t[s:e]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                cell = np.repeat(row[s:e], m) * n + q.of[at]
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
                if len(first):
                    score = np.round(np.add.reduceat(np.repeat(w[s:e], m)[order], first), SCORE_DIGITS)
                    keep.add_pairs(cell[first] % n, score, ids[cell[first] // n])
        yield keep.batch(q.ids)

    return counts.mapInArrow(run, "query_id long, vec_id long, sim double")


def _topk(docs: DataFrame, queries: DataFrame, k: int, weight: Callable, shuffled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """weight(df, n, avg_len) -> weigh of `_scored`; shuffled: the plan for larger query sets. docs have ids."""
    terms = query_terms(queries)
    if not small_enough(terms, TERMS):
        return shuffled(terms)
    own, spark = _query_index(terms), docs.sparkSession
    path = scratch(spark, "counts")
    _own_counts(docs, own.words).write.parquet(path)
    counts = spark.read.schema("doc_id long, len long, t array<int>, tf array<int>").parquet(path)
    n, total = counts.agg(F.count("*"), F.sum("len")).first()
    df = np.zeros(len(own.words))
    for r in counts.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r.t] = r.df
    hits = _scored(counts, own, k, weight(df, n, (total or 0) / max(n, 1)))
    return ranked(hits.select("query_id", F.col("vec_id").alias("doc_id"), F.col("sim").alias("score")), k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 (Robertson & Zaragoza 2009); idf = ln(1 + (n - df + 0.5) / (df + 0.5)). Documents and queries without an id don't count."""
    docs = docs.where("doc_id is not null")

    def weight(df: np.ndarray, n: int, avg_len: float):
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        return lambda t, tf, size: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg_len))

    def shuffled(terms: DataFrame) -> DataFrame:
        post, size = _matched(docs, terms), lengths(docs)
        stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        return _summed(post.join(doc_freq(post), "term").join(size, "doc_id").join(F.broadcast(stats)).select("term", "doc_id", w.alias("w")), terms, k)

    return _topk(docs, queries, k, weight, shuffled)


def tfidf_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Sum of (1 + ln tf) * ln(n / df). Documents and queries without an id don't count."""
    docs = docs.where("doc_id is not null")

    def weight(df: np.ndarray, n: int, avg_len: float):
        idf = np.log(n / np.maximum(df, 1))
        return lambda t, tf, size: (1 + np.log(tf)) * idf[t]

    def shuffled(terms: DataFrame) -> DataFrame:
        post = _matched(docs, terms)
        n = lengths(docs).agg(F.count("*").alias("n"))
        w = (1 + F.log("tf")) * F.log(F.col("n") / F.col("df"))
        return _summed(post.join(doc_freq(post), "term").join(F.broadcast(n)).select("term", "doc_id", w.alias("w")), terms, k)

    return _topk(docs, queries, k, weight, shuffled)


def boolean_match(docs: DataFrame, all_of: list[str], none_of: list[str] = ()) -> DataFrame:
    """Documents with all of some words and none of others."""
    w = tokenize("text")
    test: Column = F.forall(F.array(*map(F.lit, all_of)), lambda t: F.array_contains(w, t))
    if none_of:
        test = test & ~F.arrays_overlap(w, F.array(*map(F.lit, none_of)))
    return docs.where(test)


def phrase_match(docs: DataFrame, phrase: str) -> DataFrame:
    """doc_id, n: how often the words of a phrase follow one another. One pass, no join."""
    words = phrase.lower().split()
    begins = lambda w: F.filter(w, lambda x, i: (x == words[0]) & (F.slice(w, i + 1, len(words)) == F.array(*map(F.lit, words))))
    # As a lambda's argument the words are split out once a text; as a column they would be at every place.
    n = F.transform(F.array(tokenize("text")), lambda w: F.size(begins(w)))[0].cast("long")
    held = docs.where(F.forall(F.array(*map(F.lit, words)), lambda x: F.contains(F.lower("text"), x)))
    return held.select("doc_id", n.alias("n")).where("n > 0")


def prefix_fuzzy(terms: DataFrame, prefix: str, near: str, distance: int) -> DataFrame:
    """Terms that begin with a prefix or lie within an edit distance of a word."""
    return terms.where(F.col("term").startswith(prefix) | (F.levenshtein("term", F.lit(near)) <= distance))


def highlight(docs: DataFrame, word: str, around: int = 30) -> DataFrame:
    """doc_id, at (1-based), snippet around the first occurrence of a word's characters."""
    at = F.instr(F.lower("text"), F.lit(word))
    begin = F.greatest(F.col("at") - around, F.lit(1))
    return docs.select("doc_id", "text", at.alias("at")).where("at > 0").select("doc_id", "at", F.substring("text", begin, F.col("at") - begin + len(word) + around).alias("snippet"))
