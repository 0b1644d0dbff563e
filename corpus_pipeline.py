"""Training-corpus pipeline over `documents`: STAGES in order, each a function of (spark, docs, sf_dir).

Every stage works on all its predecessor kept and makes its decisions take effect;
all but the last return the columns of documents. Between stages rows go through
Parquet in the shared folder, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import decontam, minhash, pii, quality, spm
from loamstone.llm.common import discard, fresh, stored
from loamstone.llm.queries import tokenizers_dir


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score under 0.5) go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = fresh("__score", docs), fresh("__predicted", docs)
    return quality.score(docs, model, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The hit spans of contaminated documents go; documents half or more of which is hit go whole; clean ones stay as they are."""
    cut = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="excise", drop_from=0.5)
    return _counted(cut).select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    return _counted(pii.redact(docs)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether the ids decode to the text."""
    return spm.encode(docs, f"{tokenizers_dir(spark)}/piece_bpe_32k.model", check=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("sentencepiece", sentencepiece),
]

#: Boosted trees and soft votes are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
            if k:
                discard(before)
    return docs
