"""A stored inverted file with product-quantised residuals (Jegou, Douze & Schmid 2011), for nearest vectors by cosine.

Layout below one folder:

    model                                   centres, codebooks and what search needs to know, one row
    segments/<name>/shelf=<s>               vec_id, code, embedding, list: the vectors of some lists, sorted by list
    gone/<name>                             segment, vec_id: vectors deleted or replaced later

A list is the vectors nearest to one centre. Lists share a folder, a shelf, until some SHELF_ROWS rows fill it, so that large
tables have a folder a list and small ones few files; within a file row groups of other lists are skipped.

Centres and codebooks are fitted on a bounded sample (`sample` rows of the smallest hashes), every row is filed.
What a vector has beyond its centre is cut into `parts` pieces of equal length (a last one may be
shorter), and each piece becomes the number of the nearest of 256 codewords: a byte.

Search opens the shelves of the lists that some query probes. There, similarity is read off tables, one
value a piece: the query's own product with each codeword, and with the centre. The `keep` best of each
query so judged are compared exactly, by their own vectors, and ranked. `nprobe` and `keep` are
set when the index is made, so that each would find the root of `target` of the sample's own exact
neighbours; `keep` grows with the table, as do the vectors between a neighbour and its query.

Changes. `add` files more vectors under the same centres, replacing those of the same ids; `delete` marks.
Both count once a version of the manifest names them.

Defined results: rows with a null id, a null vector, or one with nulls or entries that aren't finite or of another
length than the most frequent one are left out. Ids must be unique within one addition (ValueError).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.operators.vectors import _HIT, DIGITS, QUERY_BLOCK, Best, IvfIndex, _gathered, _hit_rows, _matrix, _neighbours, _sample, _unit, top
from loamstone.sources.connectors import write_partitioned
from loamstone.sources.manifest import Manifest
from loamstone.sources.tables import broadcast_if_small, small_enough

WORDS, SHELF_ROWS = 256, 100_000
_ROW = "vec_id long, code binary, embedding array<float>, list int, shelf int"


@dataclass
class Codes:
    """Centres (unit vectors), and the codewords of each piece of a residual."""

    centres: np.ndarray
    books: list[np.ndarray]
    nprobe: int
    keep_share: float
    shelves: int = 1

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0] + [b.shape[1] for b in self.books])

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and the code of what it has beyond the centre."""
        home = (unit @ self.centres.T).argmax(axis=1) if len(unit) else np.zeros(0, int)
        rest, cuts = unit - self.centres[home], self.cuts
        return home, np.stack([_nearest(rest[:, cuts[m] : cuts[m + 1]], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def judged(self, unit: np.ndarray, home: int, code: np.ndarray) -> np.ndarray:
        """About the similarity of some queries to the coded vectors of one list."""
        out = np.repeat((unit @ self.centres[home])[:, None], len(code), axis=1)
        cuts = self.cuts
        for m, b in enumerate(self.books):
            out += (unit[:, cuts[m] : cuts[m + 1]] @ b.T)[:, code[:, m]]
        return out


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1) if len(x) else np.zeros(0, int)


def _codebook(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Codewords by k-means; one without members takes a random row's place."""
    words = x[rng.choice(len(x), min(WORDS, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)
        size = np.bincount(near, minlength=len(words))
        for d in range(x.shape[1]):
            words[:, d] = np.bincount(near, x[:, d], len(words)) / np.maximum(size, 1)
        words[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
    return words


def fit(vectors: DataFrame, *, parts: int = 16, lists: int | None = None, sample: int = 50_000, fit_books: int = 20_000, target: float = 0.95, k: int = 10, seed: int = 11) -> Codes | None:
    """Centres and codebooks of a bounded sample; None without vectors."""
    n = vectors.count()
    if not n:
        return None
    coarse = IvfIndex(vectors, lists, sample, target=target**0.5, seed=seed)
    x, rng = _sample(vectors, n, sample), np.random.Generator(np.random.PCG64(seed))
    rest = x - coarse.centres[(x @ coarse.centres.T).argmax(axis=1)]
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).round().astype(int)
    some = rest[:fit_books]
    codes = Codes(coarse.centres, [_codebook(some[:, s:e], rng) for s, e in zip(edges[:-1], edges[1:], strict=True)], coarse.nprobe, 1.0, int(min(len(coarse.centres), max(n // SHELF_ROWS, 1))))
    near, _ = _neighbours(x, 500, k)
    if near.size:
        home, code = codes.encode(x)
        about = np.zeros((len(near), len(x)))
        for h in np.unique(home).tolist():
            about[:, home == h] = codes.judged(x[: len(near)], h, code[home == h])
        about[np.arange(len(near)), np.arange(len(near))] = -np.inf
        place = np.argsort(np.argsort(-about, axis=1, kind="stable"), axis=1)
        codes.keep_share = float(np.quantile(np.take_along_axis(place, near, axis=1), target**0.5, method="higher") + 1) / len(x)
    return codes


class StoredIvf:
    """An index in a folder; `build` makes one, the constructor opens one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)
        row = spark.read.schema("model binary").parquet(f"{self.path}/model").first()
        self.codes: Codes | None = pickle.loads(bytes(row.model)) if row else None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, **how) -> StoredIvf:
        """Fit on a sample of the vectors (vec_id, embedding) and file them all."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        known = _known(vectors)
        length = known.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        codes = fit(known.where(F.size("embedding") == length.d), **how) if length and length.d else None
        model = [(bytearray(pickle.dumps(codes)),)] if codes else []
        spark.createDataFrame(model, "model binary").coalesce(1).write.parquet(f"{path}/model")
        index = cls(spark, path)
        if codes:
            index.add(vectors)
        return index

    def _state(self) -> tuple[int, dict]:
        version, held = self.manifest.last()
        return version, held or {"segments": [], "gone": [], "n": 0}

    def _read(self, held: dict, lists: list[int] | None = None) -> DataFrame:
        """segment and rows of the vectors that are left; of some lists only, whose folders alone are opened."""
        parts = [self.spark.read.schema(_ROW).parquet(f"{self.path}/segments/{s}").withColumn("segment", F.lit(s)) for s in held["segments"]]
        if lists is not None:
            shelves = sorted({x % self.codes.shelves for x in lists})
            parts = [p.where(F.col("shelf").isin(shelves) & F.col("list").isin(lists)) for p in parts]
        every = reduce(DataFrame.unionByName, parts)
        if held["gone"]:
            gone = self.spark.read.schema("segment string, vec_id long").parquet(*(f"{self.path}/gone/{g}" for g in held["gone"]))
            every = every.join(broadcast_if_small(gone), ["segment", "vec_id"], "left_anti")
        return every

    def _mark(self, held: dict, ids: DataFrame) -> tuple[dict, str | None]:
        name = uuid.uuid4().hex
        self._read(held).select("segment", "vec_id").join(ids, "vec_id", "left_semi").write.parquet(f"{self.path}/gone/{name}")
        n = self.spark.read.schema("segment string, vec_id long").parquet(f"{self.path}/gone/{name}").count()
        if not n:
            self.manifest.store.delete(f"gone/{name}")
            return held, None
        return held | {"gone": [*held["gone"], name], "n": held["n"] - n}, name

    def add(self, vectors: DataFrame, rows_a_file: int = 1_000_000) -> int:
        """File vectors (vec_id, embedding); those of ids that are there are replaced. Returns the version."""
        if self.codes is None:
            raise ValueError("an index made without vectors has no centres")
        codes, name = self.codes, uuid.uuid4().hex
        dims = codes.centres.shape[1]
        new = _known(vectors).where(F.size("embedding") == dims)
        if new.groupBy("vec_id").count().where("count > 1").limit(1).count():
            raise ValueError("ids must be unique within one addition")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    home, code = codes.encode(_unit(_matrix(batch.column("embedding"))))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding"), pa.array(home.astype(np.int32)), pa.array((home % codes.shelves).astype(np.int32))], names=["vec_id", "code", "embedding", "list", "shelf"])

        write_partitioned(new.mapInArrow(run, _ROW), f"{self.path}/segments/{name}", "shelf", rows_a_file=rows_a_file, sort=("list", "vec_id"))
        n = new.count()
        while True:
            version, held = self._state()
            left, marks = self._mark(held, new.select("vec_id")) if held["segments"] else (held, None)
            if self.manifest.publish(version + 1, left | {"segments": [*left["segments"], *([name] if n else [])], "n": left["n"] + n}):
                return version + 1
            if marks:
                self.manifest.store.delete(f"gone/{marks}")

    def delete(self, ids: DataFrame) -> int:
        """Take vectors (vec_id) out. Returns the version."""
        wanted = ids.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
        while True:
            version, held = self._state()
            after, marks = self._mark(held, wanted) if held["segments"] else (held, None)
            if self.manifest.publish(version + 1, after):
                return version + 1
            if marks:
                self.manifest.store.delete(f"gone/{marks}")

    def search(self, queries: DataFrame, k: int = 10, *, nprobe: int | None = None, keep: int | None = None, skip_self: bool = True) -> DataFrame:
        """query_id, vec_id, sim, rank: the k nearest that are found; ties go to the smaller id. Query sets of over QUERY_BLOCK are searched in parts."""
        _, held = self._state()
        if self.codes is None or not held["segments"]:
            return self.spark.createDataFrame([], _HIT + ", rank int")
        asked = _known(queries).where(F.size("embedding") == self.codes.centres.shape[1])
        if not small_enough(asked, QUERY_BLOCK):
            parts = 2 * -(-asked.count() // QUERY_BLOCK)
            return reduce(DataFrame.unionByName, (self.search(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p), k, nprobe=nprobe, keep=keep, skip_self=skip_self) for p in range(parts)))
        ids, unit = _gathered(asked)
        if not len(ids):
            return self.spark.createDataFrame([], _HIT + ", rank int")
        codes = self.codes
        keep = keep or max(2 * k, int(np.ceil(codes.keep_share * held["n"])))
        probed = np.argsort(-(unit @ codes.centres.T), axis=1, kind="stable")[:, : nprobe or codes.nprobe]
        lists = np.unique(probed).tolist()
        shared = self.spark.sparkContext.broadcast((ids, unit, probed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, probed = shared.value
            best = Best(len(ids), keep)
            for batch in batches:
                if not batch.num_rows:
                    continue
                home, other = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for own in np.unique(home).tolist():
                    rows, here = np.flatnonzero((probed == own).any(axis=1)), np.flatnonzero(home == own)
                    if len(rows):
                        sim = codes.judged(unit[rows], own, code[here])
                        if skip_self:
                            sim[ids[rows][:, None] == other[here][None, :]] = -np.inf
                        best.add(rows, sim, other[here])
            yield best.batch(ids)

        judged = top(self._read(held, lists).select("list", "vec_id", "code").mapInArrow(run, _HIT), keep).select("query_id", "vec_id")
        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, _ = shared.value
            for batch in batches:
                if batch.num_rows:
                    asked, other = batch.column("query_id").to_numpy(), batch.column("vec_id").to_numpy()
                    sim = np.einsum("ij,ij->i", unit[np.searchsorted(ids, asked)], _unit(_matrix(batch.column("embedding"))))
                    yield _hit_rows(asked, other, np.round(sim, DIGITS))

        exact = judged.join(self._read(held, lists).select("vec_id", "embedding"), "vec_id")
        return top(exact.select("query_id", "vec_id", "embedding").mapInArrow(compared, _HIT), k)


def _known(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows with an id and a vector of finite numbers."""
    fits = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null").where(fits)
