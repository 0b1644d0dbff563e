"""From pages and documents to chunks, and from questions to context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import html_to_text, normalize_ws, url_canonical
from loamstone.operators import chunking, lexical, ranking


def ingest_pages(pages: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks of the pages' visible text, with the canonical url. Narrow: nothing is shuffled."""
    clean = pages.select(F.col("page_id").alias("doc_id"), url_canonical("url").alias("url"), normalize_ws(html_to_text("html")).alias("text"))
    return chunking.chunk_chars(clean, size, overlap, keep=("url",))


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 5, budget: int = 4000) -> DataFrame:
    """query_id, prompt: best chunk of each of the best documents, packed into the budget."""
    hits = lexical.bm25_topk(docs, questions, k)
    wanted = hits.select("doc_id").distinct()
    chunks = chunking.chunk_chars(docs.join(wanted, "doc_id", "left_semi"))
    terms = lexical.query_terms(questions)
    words = chunks.select("doc_id", "chunk_no", F.explode(F.array_distinct(lexical.tokenize("chunk_text"))).alias("term"))
    scored = hits.select("query_id", "doc_id").join(terms, "query_id").join(words, ["doc_id", "term"]).groupBy("query_id", "doc_id", "chunk_no").agg(F.count("*").alias("score"))
    best = ranking.collapse_by_doc(scored).select("query_id", "doc_id", "chunk_no")
    placed = hits.join(best, ["query_id", "doc_id"]).join(chunks, ["doc_id", "chunk_no"]).select("query_id", "rank", F.col("chunk_text").alias("passage"), F.length("chunk_text").alias("size"))
    return ranking.prompt_assemble(ranking.context_pack(placed, budget), questions)
