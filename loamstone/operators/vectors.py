"""Vector search. Queries are a stated set; vectors are all rows.

A set of up to QUERY_BLOCK queries, by a count, is broadcast to where the vectors are.
A larger one is cut into blocks, as are the vectors, and every block of one meets every
block of the other in a task of its own, by one shuffle. Similarities are worked out in
numpy, CELLS at once, and a task keeps no more than the k best of each query, so what goes on to the
last ranking is queries x tasks x k, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions.vectors import norm
from loamstone.operators.batches import CELLS, pieces
from loamstone.sources.tables import small_enough

QUERY_BLOCK, VECTOR_BLOCK = 4096, 65_536
#: For knn_sql: pairs that a task compares, steps of an entry, and what keeps two entries of a number apart: sums of steps' products are under GAP / 2, and all under 2^53.
PAIRS, STEPS, GAP_BITS = 10_000_000, 256, 18
GAP = 1 << GAP_BITS
DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; ragged or null rows raise."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def query_set(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The stated queries: rows whose id is divisible by `every`."""
    return vectors.where(F.col("vec_id") % every == 0)


class Best:
    """The k best (query, other, similarity) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.q, self.other, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: What a new pair of each query must reach: its k-th best so far.
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, sim: np.ndarray, other: np.ndarray) -> None:
        """sim: similarities of the queries `rows` (numbers) to the ids `other`; -inf: none."""
        if not sim.size:
            return
        least = self.least[rows]
        if sim.shape[1] > self.k:
            least = np.maximum(least, np.partition(sim, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
        self.add_pairs(rows[i], sim[i, j], other[j])

    def add_pairs(self, q: np.ndarray, sim: np.ndarray, other: np.ndarray) -> None:
        """sim: similarities of queries (numbers) to ids, pair by pair."""
        self.q, self.other, self.sim = (np.concatenate(x) for x in ((self.q, q), (self.other, other), (self.sim, sim)))
        if len(self.q) > max(4 * self.n * self.k, 100_000):
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.other, -self.sim, self.q))
        q = self.q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = order[place == self.k - 1]
        self.least[self.q[last]] = self.sim[last]
        kept = order[place < self.k]
        self.q, self.other, self.sim = self.q[kept], self.other[kept], self.sim[kept]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        self.cut()
        return _hit_rows(ids[self.q], self.other, self.sim)


class _Above:
    """All that are at least so near; given out as they come."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, sim: np.ndarray, other: np.ndarray) -> None:
        i, j = np.nonzero(sim >= self.least)
        self.parts.append((rows[i], other[j], sim[i, j]))

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        q, other, sim = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.parts = []
        return _hit_rows(ids[q], other, sim)


_HIT = "query_id long, vec_id long, sim double"


def _hit_rows(q: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(sim.astype(float))], names=["query_id", "vec_id", "sim"])


def _compared(ids: np.ndarray, unit: np.ndarray, batch: pa.RecordBatch, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the queries to a batch's vectors, and their ids."""
    other = batch.column("vec_id").to_numpy()
    sim = np.round(unit @ _unit(_matrix(batch.column("embedding"))).T, DIGITS)
    if skip_self:
        sim[ids[:, None] == other[None, :]] = -np.inf
    return sim, other


def _gathered(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a query set of a checked size."""
    got = queries.select("vec_id", "embedding").toArrow().combine_chunks().sort_by("vec_id")
    return got.column("vec_id").to_numpy(), _unit(_matrix(got.column("embedding").combine_chunks()))


#: What a block of queries (ids, unit vectors) does with a batch of vectors and a keeper.
Meet = Callable[[pa.RecordBatch, "Best | _Above"], None]
Meeting = Callable[[np.ndarray, np.ndarray], Meet]


def _exact(skip_self: bool) -> Meeting:
    """All queries against all vectors."""

    def meeting(ids: np.ndarray, unit: np.ndarray) -> Meet:
        rows, step = np.arange(len(ids)), max(CELLS // max(len(ids), 1), 1)

        def meet(batch: pa.RecordBatch, keep: Best | _Above) -> None:
            for s in range(0, batch.num_rows, step):
                keep.add(rows, *_compared(ids, unit, batch.slice(s, step), skip_self))

        return meet

    return meeting


def _hits(vectors: DataFrame, queries: DataFrame, keeper: Callable[[int], Best | _Above], skip_self: bool = True, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, meeting: Meeting | None = None) -> DataFrame:
    """(query_id, vec_id, sim) of what keepers hold back."""
    n, meeting = queries.count(), meeting or _exact(skip_self)
    if n > query_block or not small_enough(queries.select("vec_id", "embedding"), query_block):
        return _block_hits(vectors, queries, n, keeper, meeting, query_block, vector_block)
    held = vectors.sparkSession.sparkContext.broadcast(_gathered(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = held.value
        if not len(ids):
            return
        keep, meet = keeper(len(ids)), meeting(ids, unit)
        for batch in batches:
            if batch.num_rows:
                meet(batch, keep)
                if isinstance(keep, _Above):
                    yield keep.batch(ids)
        if isinstance(keep, Best):
            yield keep.batch(ids)

    return vectors.select("vec_id", "embedding").mapInArrow(run, _HIT)


def _block_hits(vectors: DataFrame, queries: DataFrame, n: int, keeper: Callable[[int], Best | _Above], meeting: Meeting, query_block: int, vector_block: int) -> DataFrame:
    """Block of queries against block of vectors: a row of one side goes to as many tasks as the other has blocks."""
    left, right = _dealt(vectors, queries, n, query_block, vector_block)
    dealt = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).repartition("p", "q").sortWithinPartitions("p", "q", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, ids, meet, keep = None, [], np.zeros(0, np.int64), None, None
        for whole in batches:
            p, q, side = (whole.column(c).to_numpy() for c in ("p", "q", "side"))
            cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (side[1:] != side[:-1])]) if whole.num_rows else np.zeros(0, int)
            for s, e in zip(cut.tolist(), np.r_[cut[1:], whole.num_rows].tolist(), strict=True):
                batch = whole.slice(s, e - s)
                if (p[s], q[s]) != now:
                    if keep:
                        yield keep.batch(ids)
                    now, part, keep = (p[s], q[s]), [], None
                if side[s] == 0:
                    part.append(batch)
                    continue
                if part:
                    table = pa.Table.from_batches(part).combine_chunks()
                    ids = table.column("vec_id").to_numpy()
                    meet = meeting(ids, _unit(_matrix(table.column("embedding").combine_chunks())))
                    keep, part = keeper(len(ids)), []
                if keep:
                    meet(batch, keep)
                    if isinstance(keep, _Above):
                        yield keep.batch(ids)
        if keep:
            yield keep.batch(ids)

    return dealt.mapInArrow(run, _HIT)


def _dealt(vectors: DataFrame, queries: DataFrame, n: int, query_block: int, vector_block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors (vec_id, embedding) under p, a block of queries, and q, one of vectors, so that each two blocks meet."""
    nq, nv = -(-n // query_block), max(-(-vectors.count() // vector_block), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = queries.select("vec_id", "embedding", own(nq).alias("p")).withColumn("q", every(nv))
    right = vectors.select("vec_id", "embedding", own(nv).alias("q")).withColumn("p", every(nq))
    return left, right


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, *, skip_self: bool = True, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, vec_id, sim, rank: the k nearest (others, if ids are of one table); ties go to the smaller id."""
    return top(_hits(vectors, queries, lambda n: Best(n, k), skip_self, query_block, vector_block), k)


def top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def knn_threshold(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, vec_id, sim: all others at least so near."""
    return _hits(vectors, queries, lambda n: _Above(least))


def _unit_columns(vectors: DataFrame, key: str, prefix: str, dim: int) -> DataFrame:
    """The id as `key`, and a column a dimension of the unit vectors; zeros where there is no length. Ragged rows raise."""
    e, n = F.col("embedding"), F.col("length")
    length = F.when(F.array_size(e) != dim, F.raise_error(F.lit(f"a vector that hasn't {dim} entries"))).otherwise(norm(e))
    # No column may be null: sums of such columns compile to far less code.
    entry = lambda i: F.coalesce(F.when(n > 0, F.get(e, F.lit(i)).cast("double") / n), F.lit(0.0))
    plain, odd = vectors.select("vec_id", "embedding", length.alias("length")), F.coalesce(~(n < float("inf")), F.lit(False))
    return plain.select(F.col("vec_id").alias(key), odd.alias(f"{prefix}_odd"), *(entry(i).alias(f"{prefix}{i}") for i in range(dim)))


def _in_pairs(units: DataFrame, key: str, prefix: str, dim: int, first: int, *more: str) -> DataFrame:
    """Two entries in one number, in whole steps: of entries 2i and 2i + 1, number 2i + first counts GAP times. Odd vectors (not finite) are zeros."""
    step = lambda i: F.coalesce(F.when(~F.col(f"{prefix}_odd"), F.rint(F.col(f"{prefix}{i}") * STEPS)), F.lit(0.0)) if i < dim else F.lit(0.0)
    both = (step(2 * i + 1 - first) + step(2 * i + first) * float(GAP) for i in range((dim + 1) // 2))
    return units.select(key, f"{prefix}_odd", *more, *(x.alias(f"{prefix}p{i}") for i, x in enumerate(both)))


def knn_sql(vectors: DataFrame, queries: DataFrame, k: int = 10, *, query_block: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """knn_cosine by built-in functions alone, for where Python is not at hand.

    What is ranked must reach the query's k-th best of a sample of about sqrt(k x rows) vectors, and so is about
    queries x sqrt(k x rows) pairs. All pairs are compared in whole steps, with what these may be off, by a sum of
    products in the join's condition: two entries a column, as Spark compiles joins of up to 100 columns as one
    method, and Java such of up to 8,000 bytes. Those that may reach the bound are then compared exactly.
    Up to query_block queries (CELLS numbers) are broadcast; parts of more meet parts of the vectors.
    """
    (n, wide), (asked, wide_too) = (df.agg(F.count("*"), F.coalesce(F.max(F.array_size("embedding")), F.lit(0))).first() for df in (vectors, queries))
    dim = max(wide, wide_too)
    blocks = max(-(-asked // (query_block or max(CELLS // max(dim, 1), 1))), 1)
    parts = max(-(-n * asked // (blocks * pairs)), 1)
    share = min(max(math.sqrt(k * n), 10 * k) / max(n, 1), 1.0)
    v, q = _unit_columns(vectors, "vec_id", "v", dim), _unit_columns(queries, "query_id", "q", dim)
    near, other = sum((F.col(f"q{i}") * F.col(f"v{i}") for i in range(dim)), F.lit(0.0)), F.col("vec_id") != F.col("query_id")

    def joined(v: DataFrame, q: DataFrame, parts: int, where: Column) -> DataFrame:
        return v.repartition(parts, "vec_id").join(F.broadcast(q) if blocks == 1 else q.repartition(blocks, "query_id"), where)

    def best(both: DataFrame) -> DataFrame:
        return top(both.select("query_id", "vec_id", F.round(near, DIGITS).alias("sim")), k)

    some = v.where(F.xxhash64("vec_id").cast("double") <= (share - 0.5) * 2.0**64)
    # All pairs of the sample are ranked, so a task has a tenth of them.
    last = best(joined(some, q, math.ceil(10 * parts * share), other)).where(F.col("rank") == k)
    q = q.join(last.select("query_id", F.col("sim").alias("least"), F.col("vec_id").alias("least_id")), "query_id", "left")

    # (a + b GAP)(d + c GAP) has ac + bd GAP times, and so has the sum of these; its other parts are under GAP / 2, or count GAP^2 times.
    total = sum((F.col(f"qp{i}") * F.col(f"vp{i}") for i in range((dim + 1) // 2)), F.lit(0.0))
    steps = F.shiftright(F.shiftleft((total + GAP / 2).cast("long"), 64 - 2 * GAP_BITS), 64 - GAP_BITS)
    # An entry is off by half a step, and so a vector by sqrt(dim) / 2 of them.
    cut = F.when(~F.col("q_odd"), (F.col("least") - 10.0**-DIGITS) * STEPS**2 - (STEPS * math.sqrt(dim) + dim / 4 + 1))
    rough = _in_pairs(q.withColumn("cut", F.coalesce(cut, F.lit(float("-inf")))), "query_id", "q", dim, 0, "cut")
    maybe = joined(_in_pairs(v, "vec_id", "v", dim, 1), rough, parts, other & (F.col("v_odd") | (steps >= F.col("cut")))).select("query_id", "vec_id").distinct()

    # Rounding moves a similarity by half a digit; equal ones count up to the bound's id. The rest is for the sum's last bits.
    half = F.when(F.col("vec_id") <= F.col("least_id"), -0.5).otherwise(0.5) * 10.0**-DIGITS - 1e-9
    both = maybe.join(v.repartition(parts, "vec_id"), "vec_id").join(F.broadcast(q) if blocks == 1 else q, "query_id")
    return best(both.where(near >= F.coalesce(F.col("least") + half, F.lit(float("-inf")))))


def centroids(vectors: DataFrame) -> DataFrame:
    """label, dim, value: mean vector of each label, in long form."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("value"))


def _sample(vectors: DataFrame, n: int, most: int) -> np.ndarray:
    """Unit vectors of the `most` rows of the smallest hashes, of n; a cut-off by the count comes before the ranking."""
    h = F.xxhash64("vec_id")
    share = min(1.0, (most + 6 * math.sqrt(most) + 20) / max(n, 1))
    some = vectors.where(h.cast("double") <= (share - 0.5) * 2.0**64).orderBy(h, "vec_id").limit(most)
    return _unit(_matrix(some.select("embedding").toArrow().column("embedding").combine_chunks()))


def _neighbours(x: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and similarities of the k nearest others of a sample's first vectors."""
    q = x[: min(queries, len(x))]
    sim = q @ x.T
    sim[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    return near, np.take_along_axis(sim, near, axis=1)


class IvfIndex:
    """Inverted file: coarse centres fitted on a bounded sample, every row filed under its nearest.

    There are about as many lists as the square root of the rows (4,096 at most), so a
    list grows with the root too. A query probes the lists of its nprobe nearest centres;
    nprobe is set when the index is made, so that the sample's own exact neighbours are
    found at the `target` rate. Only lists that a query probes are compared with it; blocks of
    queries and vectors meet as in exact search.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 50_000, rounds: int = 15, target: float = 0.95, seed: int = 11) -> None:
        self.spark, self.vectors = vectors.sparkSession, vectors
        n = vectors.count()
        lists = lists or min(max(round(math.sqrt(n)), 16), 4096)
        x = _sample(vectors, n, sample)
        rng = np.random.Generator(np.random.PCG64(seed))
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0, int)
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = x[near == k].mean(axis=0)
            c = _unit(c)
        self.centres = c
        self.nprobe = self._probes(x, target)

    def _probes(self, x: np.ndarray, target: float, queries: int = 500, k: int = 10) -> int:
        """Lists to probe: the rank, among a query's lists, under which the target share of its neighbours lies."""
        if len(x) < 2:
            return 1
        near, _ = _neighbours(x, queries, k)
        place = np.argsort(np.argsort(-(x[: len(near)] @ self.centres.T), axis=1, kind="stable"), axis=1)
        home = (x @ self.centres.T).argmax(axis=1)
        return int(np.quantile(np.take_along_axis(place, home[near], axis=1), target, method="higher")) + 1

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        nprobe, c = nprobe or self.nprobe, self.centres

        def meeting(ids: np.ndarray, unit: np.ndarray) -> Meet:
            probed = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :nprobe].ravel()
            order = np.argsort(probed, kind="stable")
            cut = np.searchsorted(probed[order], np.arange(len(c) + 1))
            # The queries that probe a list, list by list.
            rows_of, step = order // min(nprobe, len(c)), max(CELLS // max(len(ids), 1), 1)

            def meet(batch: pa.RecordBatch, keep: Best) -> None:
                x, other = _unit(_matrix(batch.column("embedding"))), batch.column("vec_id").to_numpy()
                home = (x @ c.T).argmax(axis=1)
                by = np.argsort(home, kind="stable")
                lists, begin = np.unique(home[by], return_index=True)
                for own, s, e in zip(lists.tolist(), begin.tolist(), [*begin[1:].tolist(), len(by)], strict=True):
                    rows = rows_of[cut[own] : cut[own + 1]]
                    for at in range(s, e, step) if len(rows) else ():
                        here = by[at : min(at + step, e)]
                        sim = np.round(unit[rows] @ x[here].T, DIGITS)
                        sim[ids[rows][:, None] == other[here][None, :]] = -np.inf
                        keep.add(rows, sim, other[here])

            return meet

        return top(_hits(self.vectors, queries, lambda n: Best(n, k), query_block=QUERY_BLOCK, meeting=meeting), k)


def lsh_shape(n: int, sims: np.ndarray, target: float, most: int = 512) -> tuple[int, int]:
    """Bits and tables of least cost (keys and candidates a query) that find neighbours of such similarities at the target rate.

    Two vectors at an angle a agree in a random hyperplane's bit with 1 - a / pi.
    """
    agree = 1 - np.arccos(np.clip(sims, -1, 1)).ravel() / np.pi
    best = None
    for bits in range(4, 25):
        hit = agree**bits
        found = lambda t: (1 - (1 - hit) ** t).mean()  # noqa: E731, B023
        if found(most) < target and best:
            break
        tables = next((t for t in range(1, most + 1) if found(t) >= target), most)
        cost = tables * (1 + n * 2.0**-bits)
        if best is None or cost < best[0]:
            best = cost, bits, tables, found(tables)
    if best[3] < target:
        warnings.warn(f"{most} tables find {best[3]:.3f} of such neighbours, not {target}", stacklevel=2)
    return best[1], best[2]


def ann_lsh(vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.95, sample: int = 5_000, seed: int = 5) -> DataFrame:
    """Random-hyperplane hashing: candidates share a signature in one table; candidates are then ranked exactly.
    Signatures meet where blocks of queries and vectors do, so no pair is shuffled for each table it is found in.

    Bits and tables come from the number of rows and the similarities of a bounded
    sample's neighbours. Those of a sample are farther than the table's own, so recall
    is rather above the target.
    """
    n = vectors.count()
    x = _sample(vectors, n, sample)
    if len(x) < 2:
        return vectors.sparkSession.createDataFrame([], _HIT + ", rank int")
    bits, tables = lsh_shape(n, _neighbours(x, 500, k)[1], target)
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1], tables * bits))

    def keys(unit: np.ndarray) -> np.ndarray:
        return (unit @ planes > 0).reshape(len(unit), tables, bits) @ (1 << np.arange(bits))

    def meeting(ids: np.ndarray, unit: np.ndarray) -> Meet:
        step = max(CELLS // max(len(ids), tables * bits), 1)
        rows, mine = np.arange(len(ids)), np.concatenate([keys(unit[s : s + step]) for s in range(0, len(ids), step)])
        order = np.argsort(mine, axis=0, kind="stable")
        mine = np.take_along_axis(mine, order, axis=0)

        def meet(batch: pa.RecordBatch, keep: Best) -> None:
            for s in range(0, batch.num_rows, step):
                piece = batch.slice(s, step)
                x = _unit(_matrix(piece.column("embedding")))
                theirs, met = keys(x), np.zeros((len(ids), len(x)), bool)
                for t in range(tables):
                    low, high = (np.searchsorted(mine[:, t], theirs[:, t], side=way) for way in ("left", "right"))
                    size = high - low
                    met[order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()), t], np.repeat(np.arange(len(x)), size)] = True
                sim, other = _compared(ids, unit, piece, True)
                sim[~met] = -np.inf
                keep.add(rows, sim, other)

        return meet

    return top(_hits(vectors, queries, lambda n: Best(n, k), query_block=QUERY_BLOCK, meeting=meeting), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: share of the exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def embed_words(texts: DataFrame, id_col: str = "doc_id", dim: int = 256) -> DataFrame:
    """vec_id, embedding: how many words of a text fall to each dimension by the first two digits of their MD5.

    A stand-in that any engine can reproduce, where no model is at hand; texts without words are left out.
    """
    from loamstone.functions.text import tokenize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "w")):
            coded = batch.column("w").flatten().dictionary_encode()
            to = np.array([int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % dim for w in coded.dictionary.to_pylist()], int)
            size = np.diff(batch.column("w").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            counts = np.bincount(row * dim + (to[coded.indices.to_numpy()] if len(to) else row), minlength=batch.num_rows * dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(counts.reshape(batch.num_rows, dim).astype(np.float32)), pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    words = texts.select(F.col(id_col).cast("long").alias("vec_id"), tokenize("text").alias("w")).where("size(w) > 0")
    return words.mapInArrow(run, "vec_id long, embedding array<float>")


def embed_text(docs: DataFrame, dim: int = 256) -> DataFrame:
    """doc_id, embedding: unit TF-IDF vectors of hashed words, where no model is at hand."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from loamstone.functions.text import tokenize

    tf = HashingTF(numFeatures=dim, inputCol="w", outputCol="tf").transform(docs.select("doc_id", F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("w")))
    weighted = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="unit").transform(weighted).select("doc_id", vector_to_array("unit", "float32").alias("embedding"))


def embed_model(docs: DataFrame, make_predict, batch: int = 64) -> DataFrame:
    """doc_id, embedding by the caller's model: make_predict() loads it once a worker and returns texts -> matrix."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch)
    return docs.select("doc_id", predict("text").alias("embedding"))
