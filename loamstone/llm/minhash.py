"""Near-duplicate detection by min-max hashing (Ji et al. 2013).

Each permutation of a document's distinct 5-word shingles yields two signature
values, its minimum and its maximum, so 64 permutations give 128 values. Both
agree with probability J between two sets of Jaccard likeness J, and being
anticorrelated their mean has a lower variance than that of 128 minima. Runs of
`rows` values form a band; documents that share a band are candidates. With 4
values a band and 32 bands, a pair at J = 0.75 shares none with probability
5e-6, one at 0.85 with 1e-10. That is for large sets: minimum and maximum are drawn
without replacement, so of u shingles in all with c shared both agree with
c (c - 1) / (u (u - 1)), and short texts are missed more often: 1.2e-5 at c = 9 of
u = 12. Below that nothing is missed: two sets of 11 shingles in all, or fewer, that
reach 0.75 differ in two at most, so sets of up to 11 shingles have as further keys
digests of themselves without any one or two of their shingles, one of which both share.

Steps:
 1. One Arrow pass makes each text's shingle set, the set's digest and signature.
 2. Documents with equal sets form a class; its smallest id stands for it.
 3. Every bucket of a key offers a link from each member to its smallest id. Offers
    whose signatures come near the threshold are confirmed on the full 64-bit
    shingle sets, and the links contracted into components. A member that is offered to
    many is sent once a block of them, not once each.
 4. Buckets that still span several components are looked at again. Of each, the
    largest component is set apart: its members meet those of the others but not one
    another. Signatures are compared in numpy, block against block, and components with
    near members are gathered into clusters; a task returns a spanning forest of
    them, never its pairs.
 5. Clusters are dealt out with their shingle sets in the same way, and every pair of
    different components that comes near the threshold is confirmed on the full sets.
    A task returns a spanning forest of the links.
"Near" is an agreement of 0.45 in the signatures at least; a pair at 0.75 falls below
that with a probability of 5e-14 (computed).
Pairs inside one component need no check, so steps 4 and 5 lose no link that any
band shows. All that leaves a task is in proportion to its members.

Defined results: a null or wordless text has an empty set, links with nothing
and is kept. A text of one to four words has one shingle, its whole sequence.
Rows with a null id take no part (component_id is null, kept is true). Where an id
repeats, rows are numbered and each is judged by its own text; of a component one row
of the smallest id is kept, so literal repeats of a row leave one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import NONSPACE, discard, fresh, mix, ngram_hashes, row_words, slices, stored, tidy
from loamstone.llm.components import components

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
THRESHOLD = 75  # in hundredths
#: Members of a side of a block, and partners that one sending of a set is for.
BLOCK, PARTNERS = 256, 256
#: Sets of so many shingles at most have exact keys.
SMALL = 11
#: Rows broadcast at most: 2 million of one or four numbers, 32 to 80 MB.
BROADCAST_IDS = 2_000_000
_rng = np.random.Generator(np.random.PCG64(977))
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, text_col: str = "text", n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within the row, and the rows' offsets."""
    words, rows = row_words(batch.column(text_col), NONSPACE)
    grams = ngram_hashes(words, n)
    sets = []
    for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if e - s >= n:
            sets.append(np.unique(grams[s : e - n + 1]))
        elif e > s:
            sets.append(ngram_hashes(words[s:e], e - s))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, sets)])


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 (rows, 2 * PERMUTATIONS): minimum and maximum under each permutation; empty sets give zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2 * PERMUTATIONS), np.uint32)
    if len(full):
        at = offsets[:-1][full]
        for k in range(PERMUTATIONS):
            v = ((sets ^ _B[k]) * _A[k] >> np.uint64(32)).astype(np.uint32)
            out[full, 2 * k] = np.minimum.reduceat(v, at)
            out[full, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def small_keys(grams: np.ndarray) -> np.ndarray:
    """Digests of a set of up to SMALL shingles without none, one or two of them, as far as two sets at 0.75 can differ."""
    n = len(grams)
    if not 3 <= n <= SMALL:
        return np.zeros(0, np.int64)
    each = mix(grams)
    total = each.sum(dtype=np.uint64)
    keys = [np.array([mix(np.array([total + np.uint64(n)]))[0]]), mix(total - each + np.uint64(n - 1))]
    if n >= 8:
        i, j = np.triu_indices(n, 1)
        keys.append(mix(total - each[i] - each[j] + np.uint64(n - 2)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, signature, small) of every row; class is a digest of the set, small its exact keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                sets, offsets = shingle_sets(batch, text_col)
                sig = signatures(sets, offsets)
                own = [sets[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cls = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(cls, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([small_keys(x) for x in own], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "signature", "small"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_shingles long, class binary, signature binary, small array<long>")


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it has BROADCAST_IDS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs with one of the ids (distinct, in id_col).

    Up to BROADCAST_IDS ids (16 bytes each) are broadcast, so texts stay where they
    are; more are joined by a shuffle.
    """
    return docs.join(_few(ids), id_col, "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grams) of the wanted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                data, offsets = shingle_sets(batch, text_col)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array([data[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["id", "grams"])

    return _only(docs.select(id_col, text_col), ids.select(F.col("id").alias(id_col)).distinct(), id_col).mapInArrow(tidy(run), "id long, grams binary")


def _words(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _judge(pairs: DataFrame, values: DataFrame, keep: Callable[[pa.Buffer, pa.Buffer], bool]) -> DataFrame:
    """The pairs (a, b) whose values `keep` accepts. values: (id, v), v binary.

    a's value is asked for once for each PARTNERS of its pairs, b's once a pair; all
    come in one join, and a's is sorted before those of its partners.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    hot = _few(many.where(F.col("n") > PARTNERS).select("a", F.ceil(F.col("n") / PARTNERS).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    right = pairs.join(hot, "a", "left").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"), "b")
    left = many.join(hot, "a", "left").select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("b"))
    asked = left.union(right).join(values.select("id", "v"), "id").select("a", "block", "b", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, None
        for batch in batches:
            a, block, b = (batch.column(c).to_pylist() for c in ("a", "block", "b"))
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y, z) in enumerate(zip(a, block, b, strict=True)):
                if z is None:
                    now, value = (x, y), batch.column("v")[k].as_py()
                elif now == (x, y):
                    good[k] = keep(value, batch.column("v")[k].as_buffer())
            yield batch.select(["a", "b"]).filter(pa.array(good))

    dealt = asked.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(tidy(run), "a long, b long")


def _floor(threshold: int) -> int:
    """Agreeing signature values under which a pair is not looked at: 0.3 below the threshold, 7.8 standard errors at 0.75."""
    return int(max(0.0, threshold / 100 - 0.3) * 2 * PERMUTATIONS)


def _confirm(pairs: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets meet the threshold. signed: (id, signature)."""
    floor = _floor(threshold)

    def near(x: pa.Buffer, y: pa.Buffer) -> bool:
        return int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) >= floor

    def alike(x: pa.Buffer, y: pa.Buffer) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(p, q, assume_unique=True))
        return 100 * common >= threshold * (len(p) + len(q) - common)

    some = stored(_judge(pairs, signed.withColumnRenamed("signature", "v"), near), "minhash-near")
    sets = _sets(docs, some.select(F.col("a").alias("id")).union(some.select(F.col("b").alias("id"))), id_col, text_col)
    links = stored(_judge(some, sets.withColumnRenamed("grams", "v"), alike), "minhash-links")
    discard(some)
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if s == e:
                continue
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over the components that a task sees."""

    def __init__(self, labels: np.ndarray) -> None:
        self.names, self.of = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(self.names))

    def roots(self) -> np.ndarray:
        """Root of each member's component."""
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root[self.of]
            self.root = up

    def join(self, x: int, y: int) -> bool:
        x, y = (self._find(k) for k in (x, y))
        self.root[max(x, y)] = min(x, y)
        return x != y

    def _find(self, k: int) -> int:
        while self.root[k] != k:
            k = int(self.root[k])
        return k


def _mixed(members: DataFrame, key: str) -> DataFrame:
    """(key, main, main_n, rest_n): groups with several components; main is the largest of them."""
    each = members.groupBy(key, "component").agg(F.count("*").alias("n"))
    every = each.groupBy(key).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return every.select(key, F.col("top.component").alias("main"), F.col("top.n").alias("main_n"), (F.col("n") - F.col("top.n")).alias("rest_n"))


def _blocks(members: DataFrame, mixed: DataFrame, key: str, block: int) -> DataFrame:
    """Members (key, id, component, ...) of mixed groups dealt to pairs of blocks (p, q), sorted by them.

    Blocks from 0 hold members of all components but the main one, later ones those of
    the main one. Every block meets all of the first kind, so the main component's
    members never meet one another: N of them and a few others cost N rows and a few for
    each block, not the square.
    """
    cut = members.join(_few(mixed), key)
    rest, main = (F.ceil(F.col(c) / block).cast("int") for c in ("rest_n", "main_n"))
    inside = F.col("component") == F.col("main")
    own = F.when(inside, rest + F.pmod(F.xxhash64("id"), main)).otherwise(F.pmod(F.xxhash64("id"), rest)).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(inside, rest - 1).otherwise(rest + main - 1)))
    sides = cut.withColumn("own", own).withColumn("other", met)
    dealt = sides.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "main", "main_n", "rest_n")
    return dealt.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def _near(t: pa.Table, floor: int) -> Iterator[tuple[int, np.ndarray, _Forest]]:
    """For each left member: the right members of other components near it. The forest may be joined on meanwhile."""
    own = t.column("own").to_numpy()
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(len(own), -1)
    ids, forest = t.column("id").to_numpy(), _Forest(t.column("component").to_numpy())
    right = np.flatnonzero(own == t.column("q")[0].as_py())
    roots = forest.roots()
    if len(forest.names) < 2:
        return
    for i in np.flatnonzero(own == t.column("p")[0].as_py()).tolist():
        far = right[(roots[right] != roots[i]) & ((ids[right] > ids[i]) | (own[right] != own[i]))]
        if len(far):
            near = far[(sig[far] == sig[i]).sum(axis=1) >= floor]
            if len(near):
                yield i, near, forest
                roots = forest.roots()


def _clusters(members: DataFrame, mixed: DataFrame, threshold: int, block: int) -> DataFrame:
    """Edges (a, b) between components of one bucket that have near members; a spanning forest a task. members: (key, id, component, signature)."""
    floor = _floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "p", "q"]):
            a, b = [], []
            for i, near, forest in _near(t, floor):
                for j in near.tolist():
                    x, y = int(forest.of[i]), int(forest.of[j])
                    if forest.join(x, y):
                        a.append(int(forest.names[x]))
                        b.append(int(forest.names[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = _blocks(members, mixed, "key", block).select("key", "p", "q", "own", "id", "component", "signature")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _links(members: DataFrame, mixed: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links (a, b) between different components of a cluster; a spanning forest a task. members: (cluster, id, component, signature, grams)."""
    floor = _floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["cluster", "p", "q"]):
            ids = t.column("id").to_numpy()
            grams = _words(t.column("grams"), np.uint64)
            size = np.array([len(g) for g in grams])
            a, b = [], []
            for i, near, forest in _near(t, floor):
                near = near[100 * np.minimum(size[near], size[i]) >= threshold * np.maximum(size[near], size[i])]
                if not len(near):
                    continue
                every = np.concatenate([grams[j] for j in near.tolist()])
                at = np.minimum(np.searchsorted(grams[i], every), size[i] - 1)
                common = np.add.reduceat((grams[i][at] == every).astype(np.int64), np.cumsum(size[near]) - size[near])
                for j in near[100 * common >= threshold * (size[near] + size[i] - common)].tolist():
                    if forest.join(int(forest.of[i]), int(forest.of[j])):
                        a.append(min(int(ids[i]), int(ids[j])))
                        b.append(max(int(ids[i]), int(ids[j])))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = _blocks(members, mixed, "cluster", block).select("cluster", "p", "q", "own", "id", "component", "signature", "grams")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where("i is not null")
    return not ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs with a number of each row that has an id, written so that numbers stay, and that column's name."""
    row = fresh("__row", docs)
    return stored(docs.withColumn(row, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "minhash-rows"), row


def _by_row(numbered: DataFrame, row: str, id_col: str, **options) -> DataFrame:
    """near_duplicates of rows that repeat ids, with their numbers as `row`: of each component the first row of the smallest id is kept."""
    judged = _judged(numbered, id_col=row, **options).withColumnRenamed("doc_id", "row")
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id")).where("row is not null")
    some = judged.where("row is not null").select("row", "n_shingles", F.col("component_id").alias("part")).join(ids, "row")
    first = some.groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    named = some.join(first, "part").select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("kept"))
    none = judged.where("row is null").select("row", F.lit(None).cast("long").alias("doc_id"), "n_shingles", "component_id", "kept")
    return named.unionByName(none)


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    options = {"threshold": threshold, "text_col": text_col, "rows": rows, "block": block}
    if _repeats(docs, id_col):
        return _by_row(*_numbered(docs.select(id_col, text_col), id_col), id_col, **options).drop("row")
    return _judged(docs, id_col=id_col, **options)


def _judged(docs: DataFrame, *, threshold: int, id_col: str, text_col: str, rows: int, block: int) -> DataFrame:
    """near_duplicates of rows whose ids are distinct or null."""
    width = 4 * rows
    bands = 2 * PERMUTATIONS // rows
    seen = stored(profiles(docs, id_col, text_col), "minhash-profiles")
    some = seen.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.struct("signature", "small")).alias("v"))
    classes = stored(classes.select("class", "rep", "v.signature", "v.small"), "minhash-classes")
    banded = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
    spread = classes.select(F.col("rep").alias("id"), F.explode(F.concat(banded, "small")).alias("key"))
    buckets = spread.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = stored(spread.join(buckets, "key"), "minhash-buckets")
    stars = stored(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "minhash-stars")
    signed = classes.select(F.col("rep").alias("id"), "signature")
    links = _confirm(stars, signed, docs, id_col, text_col, threshold)
    discard(stars)
    found = components(links, "a", "b", "minhash-components")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    here = placed(members.select("key", "id"))
    mixed = stored(_mixed(here, "key"), "minhash-mixed")
    some = here.join(_few(mixed.select("key")), "key", "left_semi").join(signed, "id")
    edges = stored(_clusters(some, mixed, threshold, block), "minhash-near-components")
    discard(members)
    clusters = components(edges, "a", "b", "minhash-clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    parts = stored(placed(signed).join(clusters, "component"), "minhash-parts")
    mixed = stored(_mixed(parts, "cluster"), "minhash-mixed")
    more = stored(_links(parts.join(_sets(docs, parts.select("id"), id_col, text_col), "id"), mixed, threshold, block), "minhash-more")
    discard(parts)
    if not more.isEmpty():
        found = components(links.union(more), "a", "b", "minhash-components")

    named = classes.select("class", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    full = F.expr("doc_id is not null and n_shingles > 0")
    linked = seen.where(full).select("doc_id", "n_shingles", "class").join(named, "class").select("doc_id", "n_shingles", "component_id")
    alone = seen.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", threshold: int = THRESHOLD, text_col: str = "text", rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest id; rows in no group stay."""
    options = {"threshold": threshold, "text_col": text_col, "rows": rows, "block": block}
    if _repeats(docs, id_col):
        held, key = _numbered(docs, id_col)
        judged = _by_row(held, key, id_col, **options).withColumnRenamed("row", key)
    else:
        held, key = docs, id_col
        judged = _judged(docs, id_col=id_col, **options).withColumnRenamed("doc_id", id_col)
    gone = stored(judged.where("not kept").select(key), "minhash-gone")
    return held.join(_few(gone), key, "left_anti").select(*docs.columns)
