"""Trained text embeddings: latent semantic analysis (Deerwester et al. 1990) by a randomised SVD (Halko, Martinsson & Tropp 2011).

Texts become unit vectors of (1 + ln tf) * ln(n / df) over FEATURES hashed words. The matrix A of all
of them stays where the texts are: each pass multiplies A's own rows with a block of features x (dim + EXTRA)
that is broadcast (19 MB at most, whatever the input), and tasks hand on sums by feature. `rounds` passes of
A'A with an orthogonal basis kept in between, and one of the small product (AQ)'(AQ), whose eigenvectors turn the basis
into A's right singular vectors. Products are taken in pieces of CELLS numbers. A text's embedding is its row times these, made a unit vector.

Defined results: texts without words, null ones too, have no embedding, nor has a row with a null id.
A word of all texts has no weight. The fit depends on the texts alone, but for the order of floating-point sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import tokenize
from loamstone.operators import batches as B
from loamstone.sources.tables import scratch

FEATURES, EXTRA = 1 << 16, 10


@dataclass
class Lsa:
    """Weights of features, and a column of `axes` a dimension."""

    idf: np.ndarray
    axes: np.ndarray

    def embed(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """vec_id, embedding: unit vectors."""
        shared = texts.sparkSession.sparkContext.broadcast((self.idf, self.axes.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, axes = shared.value
            for whole in batches:
                for batch in B.pieces(whole, "w"):
                    row, at, w = _weights(batch.column("w"), idf)
                    out = _add_products(np.zeros((batch.num_rows, axes.shape[1])), row, w, axes, at)
                    size = np.linalg.norm(out, axis=1, keepdims=True)
                    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), B.rows_of(out, pa.float32())], names=["vec_id", "embedding"])

        return _words(texts, id_col, text_col).mapInArrow(run, "vec_id long, embedding array<float>")


def _words(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), tokenize(F.col(f"`{text_col}`")).alias("w")).where("vec_id is not null and size(w) > 0")


def _counted(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of the distinct features of each row."""
    coded = words.flatten().dictionary_encode()
    to = np.array([zlib.crc32(w.encode()) % FEATURES for w in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    key, tf = np.unique(row * FEATURES + to[coded.indices.to_numpy()], return_counts=True)
    return key // FEATURES, key % FEATURES, tf


def _weights(words: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of each row's unit vector."""
    row, at, tf = _counted(words)
    w = (1 + np.log(tf)) * idf[at]
    size = np.sqrt(np.bincount(row, w * w, len(words)))
    return row, at, np.divide(w, size[row], out=np.zeros_like(w), where=size[row] > 0)


def _add_products(out: np.ndarray, to: np.ndarray, w: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Adds w times the table's rows `at` to the rows `to` (rising) of out, no more than CELLS numbers at once."""
    step = max(B.CELLS // max(table.shape[1], 1), 1)
    for s in range(0, len(to), step):
        own = to[s : s + step]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[begin]] += np.add.reduceat(w[s : s + step, None] * table[at[s : s + step]], begin, axis=0, dtype=float)
    return out


def fit(docs: DataFrame, dim: int = 64, *, rounds: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Lsa:
    """Axes of all texts; fewer than dim where texts or words are."""
    spark = docs.sparkSession
    path = scratch(spark, "lsa")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in B.pieces(whole, "w")):
            row, at, tf = _counted(batch.column("w"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int32)))], names=["at", "tf"])

    _words(docs, id_col, text_col).select("w").mapInArrow(count, "at array<int>, tf array<int>").write.parquet(path)
    rows = spark.read.schema("at array<int>, tf array<int>").parquet(path)
    n, df = rows.count(), np.zeros(FEATURES)
    for r in rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():
        df[r["at"]] = r.df
    idf = np.where(df > 0, np.log(np.maximum(n, 1) / np.maximum(df, 1)), 0.0)
    width = min(dim + EXTRA, n, int((idf > 0).sum()))
    if width < 1:
        return Lsa(idf, np.zeros((FEATURES, 0)))

    def taken(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, tf = batch.column("at").flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy()))
        w = (1 + np.log(tf)) * idf[at]
        size = np.sqrt(np.bincount(row, w * w, batch.num_rows))
        return row, at, np.divide(w, size[row], out=np.zeros_like(w), where=size[row] > 0)

    def times(basis: np.ndarray) -> np.ndarray:
        """A'A times the basis."""
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total, seen = np.zeros(q.shape), np.zeros(FEATURES, bool)
            for batch in (piece for whole in batches for piece in B.pieces(whole, "at")):
                row, at, w = taken(batch)
                y = _add_products(np.zeros((batch.num_rows, q.shape[1])), row, w, q, at)
                order = np.argsort(at, kind="stable")
                _add_products(total, at[order], w[order], y, row[order])
                seen[at] = True
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), B.rows_of(total[some], pa.float64())], names=["at", "v"])

        sums = rows.mapInArrow(run, "at int, v array<double>").groupBy("at").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(basis.shape[1]))).alias("v"))
        out = np.zeros(basis.shape)
        got = sums.toArrow()
        out[got.column("at").to_numpy()] = np.array(got.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, basis.shape[1])
        return out

    def small(basis: np.ndarray) -> np.ndarray:
        """(AQ)'(AQ)."""
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total = np.zeros((q.shape[1], q.shape[1]))
            for batch in (piece for whole in batches for piece in B.pieces(whole, "at")):
                row, at, w = taken(batch)
                y = _add_products(np.zeros((batch.num_rows, q.shape[1])), row, w, q, at)
                total += y.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

        parts = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(basis.shape[1] ** 2)
        out[parts.column("k").to_numpy()] = parts.column("v").to_numpy()
        return out.reshape(basis.shape[1], -1)

    basis = np.random.Generator(np.random.PCG64(seed)).standard_normal((FEATURES, width)) * (idf > 0)[:, None]
    for _ in range(rounds + 1):
        basis, _ = np.linalg.qr(times(basis))
    e, u = np.linalg.eigh(small(basis))
    keep = e[::-1][:dim] > max(e[-1], 0) * 1e-9
    axes = (basis @ u[:, ::-1][:, :dim])[:, keep]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] if axes.shape[1] else np.zeros(0)
    return Lsa(idf, axes * np.where(lead < 0, -1.0, 1.0))


