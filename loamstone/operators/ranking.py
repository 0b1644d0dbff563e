"""Fusion of rankings, reranking, context assembly and evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.sources.tables import fresh

KEYS = ["query_id", "doc_id"]
DIGITS = 9


def hybrid_rrf(rankings: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al. 2009): the sum of 1 / (constant + rank). A union and one sum; no outer joins."""
    parts = [r.select(*KEYS, (1.0 / (constant + F.col("rank"))).alias("s")) for r in rankings]
    every = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return top(every, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def minmax(hits: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    span = F.max("score").over(w) - F.min("score").over(w)
    return hits.select(*KEYS, F.when(span > 0, (F.col("score") - F.min("score").over(w)) / span).otherwise(1.0).alias("s"))


def hybrid_weighted(rankings: list[tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """Weighted sum of scaled scores."""
    parts = [minmax(r).withColumn("s", F.col("s") * weight) for r, weight in rankings]
    return top(reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.round(F.sum("s"), DIGITS).alias("score")), k)


def rerank_mmr(hits: DataFrame, k: int = 5, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance (Carbonell & Goldstein 1998). hits: query_id, doc_id, score, embedding.

    Greedy by nature, so it runs in Python, one query's candidate list at a time;
    the list is a ranking's top and so bounded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array(pdf["embedding"].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        score, near = pdf["score"].to_numpy(float), np.zeros(len(pdf))
        left, out = list(range(len(pdf))), []
        while left and len(out) < k:
            value = [trade * score[i] - (1 - trade) * (near[i] if out else 0.0) for i in left]
            best = left.pop(int(np.argmax(value)))
            out.append(best)
            near = np.maximum(near, m @ m[best]) if len(out) > 1 else m @ m[best]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[out].to_numpy(), "doc_id": pdf["doc_id"].iloc[out].to_numpy(), "rank": np.arange(1, len(out) + 1, dtype=np.int32)})

    return hits.select(*KEYS, "score", "embedding").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int")


def collapse_by_doc(chunk_hits: DataFrame) -> DataFrame:
    """The best chunk of each document and query; ties go to the earlier chunk."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "chunk_no")
    rn = fresh("__rn", chunk_hits)
    return chunk_hits.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def context_pack(ranked: DataFrame, budget: int, size_col: str = "size") -> DataFrame:
    """Hits in rank order until the budget is spent; adds used, the running sum."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("used", F.sum(size_col).over(w)).where(F.col("used") <= budget)


def prompt_assemble(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt: numbered passages in rank order, then the question. packed: query_id, rank, passage."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("passage"))
    lines = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("xs"))
    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return lines.join(asked, "query_id").select("query_id", F.concat(F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def chat_history(turns: DataFrame, last: int = 4) -> DataFrame:
    """conv_id, history: the last turns of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    kept = turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    lines = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rn", F.concat("role", F.lit(": "), "text").alias("line"))), asc=False).alias("xs"))
    return lines.select("conv_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("history"))


def evaluate(hits: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr, hit, ndcg. hits: query_id, rank, rel (0/1), n_relevant (of the query)."""
    gain = F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("n_relevant"), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    n = F.max("n_relevant")
    found = F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    return hits.groupBy("query_id").agg(
        F.round(found / k, DIGITS).alias("precision"),
        F.round(F.when(n > 0, found / n).otherwise(0.0), DIGITS).alias("recall"),
        F.round(F.coalesce(F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1.0 / F.col("rank"))), F.lit(0.0)), DIGITS).alias("mrr"),
        F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1).otherwise(0)).alias("hit"),
        F.round(F.when(n > 0, F.sum(gain) / ideal).otherwise(0.0), DIGITS).alias("ndcg"),
    )


def faithfulness(answers: DataFrame) -> DataFrame:
    """id, overlap: share of an answer's distinct words that its context holds. answers: id, answer, context."""
    from loamstone.functions.text import tokenize

    a, c = F.array_distinct(tokenize("answer")), F.array_distinct(tokenize("context"))
    return answers.select("id", F.round(F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a)).otherwise(0.0), DIGITS).alias("overlap"))
