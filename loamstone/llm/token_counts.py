"""Token totals by source, language and tokenizer version, kept up to date by deltas.

The ledger is a folder. A commit turns signed changes (inserts, deletes, revised
counts) into sums by key and writes them as one small Parquet table under a fresh
attempt name. Then it publishes the marker `commits/<batch>`, which names that table: the marker is
written whole under another name and then given its own, which fails if the batch has a
marker already. The marker is the commit: of several attempts at a batch the first to
publish counts, replays do nothing, and attempts without a marker (lost executors,
killed drivers) are never read.

`compact` folds all committed deltas into the next generation, which lists the batches
in it. A generation is published the same way under its number, so of several
compactions at once one counts and the others withdraw. Totals are the last generation
and the deltas of the batches that it doesn't list. What a generation folded in is
deleted when the next one is published, so a reader that has just listed it still finds
its files. Markers stay: they make replays do nothing.

Publishing is a hard link on local disks, elsewhere Hadoop's rename that doesn't
replace, which is atomic on HDFS. Markers are read by a Spark scan; what the driver
lists are the deltas since the last compaction.

Hot sources are summed before they are shuffled, so a key costs a row a task. Markers
are listed and read by a Spark scan, not one by one on the driver.

Defined results: null source or language is a key of its own. A null text has no
tokens but counts as a document. Null counts in changes count as 0. An empty
batch commits and changes nothing. Keys whose totals are all 0 are left out.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import NONSPACE, fresh, slices, text_buffer, word_spans
from loamstone.sources.manifest import Store

KEYS = ["source", "lang", "tokenizer"]
#: The usual word pattern of byte-level vocabularies of 50,000 entries (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level BPE vocabulary in a ranks file that every worker can open."""

    version: str
    path: str
    pattern: str = PATTERN

    def count(self, column: pa.Array) -> np.ndarray:
        enc = _encoding(self.path, self.pattern)
        return np.array([len(enc.encode_ordinary(t)) if t else 0 for t in column.to_pylist()], np.int64)


@dataclass(frozen=True)
class Words:
    """Runs of anything but ASCII white space."""

    version: str = "words"

    def count(self, column: pa.Array) -> np.ndarray:
        return np.diff(word_spans(*text_buffer(column), NONSPACE)[2]).astype(np.int64)


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: list[ByteBpe | Words], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document and tokenizer: the kept columns, tokenizer, n_tokens."""
    keep = ["doc_id", "source", "lang"] if keep is None else keep
    text = fresh("__text", docs)
    base = docs.select(*keep, F.col(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                for t in tokenizers:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([t.version] * batch.num_rows, pa.string()), pa.array(t.count(batch.column(text)))], names=[*keep, "tokenizer", "n_tokens"])

    fields = [f for f in base.schema.fields if f.name != text]
    return base.mapInArrow(run, T.StructType([*fields, T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())]))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes from one snapshot of counts (doc_id, keys, n_tokens) to the next.

    What both hold alike cancels out; a revised count or a moved document leaves
    the difference. No join is needed: signs add up by key.
    """
    return deletes(before).union(inserts(after))


_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
#: fresh: folded in by this generation, not by one before it.
_FOLDED = "batch string, delta string, fresh boolean"


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._store = Store(spark, self.path)
        for folder in ("commits", "generations", "parts"):
            self._fs.mkdirs(self._at(f"{self.path}/{folder}"))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Apply signed changes (KEYS, docs, tokens) once; False if the batch is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        marker = f"{self.path}/commits/{batch}"
        if self._fs.exists(self._at(marker)) or self._folded(batch):
            return False
        attempt = f"{batch}.{uuid.uuid4().hex}"
        sums = signed.groupBy(*KEYS).agg(F.sum(F.coalesce("docs", F.lit(0))).alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").write.parquet(f"{self.path}/deltas/{attempt}")
        if self._publish(marker, json.dumps({"batch": batch, "delta": attempt})):
            if not self._folded(batch, but=attempt):
                return True
            self._delete(f"commits/{batch}")  # another attempt was committed and folded in meanwhile, and its marker deleted
        self._delete(f"deltas/{attempt}")
        return False

    def _folded(self, batch: str, but: str | None = None) -> bool:
        """Whether the last generation holds the batch, by another attempt than `but`."""
        _, folder = self._last()
        if not folder:
            return False
        held = self.spark.read.schema(_FOLDED).parquet(f"{self.path}/{folder}/batches").where(F.col("batch") == batch)
        return any(r.delta != but for r in held.select("delta").collect())

    def _publish(self, name: str, content: str) -> bool:
        """Create a file whole, or not at all if there is one of that name; content names the attempt, so its own file is known even if the reply is lost."""
        return self._store.create(name.removeprefix(f"{self.path}/"), content)

    def _delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def _last(self) -> tuple[int, str | None]:
        """Number and folder of the last generation; 0 without one."""
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(self._at(f"{self.path}/generations")) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, None
        n = max(numbers)
        return n, self.spark.read.text(f"{self.path}/generations/{n}").first()[0]

    def _waiting(self, folder: str | None) -> list[tuple[str, str]]:
        """Batches, with their deltas, that are committed and not in the generation of that folder."""
        marks = self.spark.read.schema("batch string, delta string").json(f"{self.path}/commits")
        if folder:
            marks = marks.join(self.spark.read.schema(_FOLDED).parquet(f"{self.path}/{folder}/batches"), "batch", "left_anti")
        return sorted((r.batch, r.delta) for r in marks.collect())

    def _sums(self, folder: str | None, waiting: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/deltas/{d}" for _, d in waiting] + ([f"{self.path}/{folder}/sums"] if folder else [])
        found = self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)
        return found.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        _, folder = self._last()
        return self._sums(folder, self._waiting(folder))

    def compact(self) -> bool:
        """Fold all committed deltas into the next generation; False if another compaction came first."""
        n, before = self._last()
        waiting = self._waiting(before)
        folder = f"folded/{n + 1}.{uuid.uuid4().hex}"
        self._sums(before, waiting).select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.parquet(f"{self.path}/{folder}/sums")
        batches = self.spark.createDataFrame([(b, d, True) for b, d in waiting], _FOLDED)
        old = self.spark.read.schema(_FOLDED).parquet(f"{self.path}/{before}/batches") if before else None
        (batches if old is None else batches.union(old.withColumn("fresh", F.lit(False)))).write.parquet(f"{self.path}/{folder}/batches")
        if not self._publish(f"{self.path}/generations/{n + 1}", folder):
            self._delete(folder)
            return False
        if old is not None:
            for r in old.where("fresh").collect():
                self._delete(f"deltas/{r.delta}")
                self._delete(f"commits/{r.batch}")
        if n > 1:
            self._delete(self.spark.read.text(f"{self.path}/generations/{n - 1}").first()[0])
        return True
