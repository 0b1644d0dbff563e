"""Cutting documents into chunks. Output: doc_id, chunk_no, start, end (code points, end exclusive), chunk_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loamstone.functions.text import tokenize


def chunk_chars(docs: DataFrame, size: int = 500, overlap: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of `size` characters, each beginning size - overlap after the last; a text has one at least. keep: further columns."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    cut = docs.where(F.length("text") > 0).select("doc_id", *keep, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    return cut.select("doc_id", *keep, "chunk_no", start.alias("start"), F.least(start + size, F.length("text")).alias("end"), F.expr(f"substring(text, chunk_no * {step} + 1, {size})").alias("chunk_text"))


def chunk_tokens(docs: DataFrame, size: int = 128, stride: int = 96) -> DataFrame:
    """Windows of `size` words; chunk_text is the words joined by spaces."""
    t = docs.select("doc_id", tokenize("text").alias("w")).where("size(w) > 0")
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - (size - stride)) / stride)).cast("int")
    cut = t.select("doc_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return cut.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * stride + 1, size), " ").alias("chunk_text"))


def chunk_paragraphs(docs: DataFrame) -> DataFrame:
    """Non-blank lines, numbered by their place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "chunk_text"))
    return lines.where(F.trim("chunk_text") != "")


def chunk_sentences(docs: DataFrame, budget: int = 400) -> DataFrame:
    """Whole sentences packed up to `budget` characters; a longer sentence is a chunk of its own.

    The fold is one expression, so a document never leaves its row.
    """
    parts = F.filter(F.split("text", r"(?<=[.!?])[ \n]+"), lambda s: F.length(s) > 0)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, s):
        joined = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        full = (a["open"] != "") & (F.length(joined) > budget)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    packed = F.aggregate(parts, state, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "chunk_text"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_no, sentence: text after . ! or ? and white space begins a new one."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"[.!?][ \n]+"), lambda s: F.length(s) > 0)).alias("sentence_no", "sentence"))


def chunk_neighbors(chunks: DataFrame) -> DataFrame:
    """Each chunk with the one before and after it in its document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    return chunks.withColumns({"previous": F.lag("chunk_text").over(w), "next": F.lead("chunk_text").over(w)})


@udtf(returnType="chunk_no int, chunk_text string")
class FixedChunks:
    """Non-overlapping chunks of n characters, as a table function for splitters that SQL can't say."""

    def eval(self, text: str, n: int):
        for k, at in enumerate(range(0, len(text or ""), n)):
            yield k, text[at : at + n]


def chunk_udtf(spark: SparkSession, docs: DataFrame, size: int = 500) -> DataFrame:
    spark.udtf.register("fixed_chunks", FixedChunks)
    docs.createOrReplaceTempView("__chunk_docs")
    return spark.sql(f"SELECT d.doc_id, c.chunk_no, c.chunk_text FROM __chunk_docs d, LATERAL fixed_chunks(d.text, {int(size)}) c")
