"""Language-model scores: an interpolated modified Kneser-Ney model of any order from 2.

Counting is Spark's: each task turns its texts into numbers, sums equal n-grams
and deals the sums to hash ranges ("shards"), where they are merged, sorted and
written to the shared folder as arrays: sorted 64-bit keys, and columns of counts.
There are as many shards as spark.sql.shuffle.partitions, one a task, and as n-grams
are dealt by hash, one text, source or word cannot make one shard large. Workers
memory-map the shards and look n-grams up in sorted order, so the model is neither sent
to the driver nor broadcast, and a machine holds one copy of the pages it uses.

 1. Words (A-Z lowered, cut at ASCII white space) -> sorted hashes and counts.
    A word's number is its place in them.
 2. For n = 2 to the order: the number of a text's n-1 words before a word and the
    word's own, packed into 64 bits and multiplied by an odd constant (which can be
    undone), -> sorted keys and counts. An n-gram's number is its place in them.
 3. From the order down to 2: each shard yields, for its contexts, how many followers
    were seen once, twice and more often (below the order: have so many words before
    them), and for its n-grams without their first word how many words precede them;
    these are summed by number.
 4. Scores: discounts from the counts of counts (Chen & Goodman 1998), each order
    interpolated with the continuation shares of the next lower, the lowest with the
    uniform 1 / (V + 1). A text's start precedes its first word once, however high the
    order; what begins with it keeps its plain counts in lower orders, as nothing
    precedes it (as in KenLM).

Writing a column ends with a rename, and its content depends on the data alone, so
a task that runs again after its executor is lost does no harm. The shared
folder should be mounted on the workers; elsewhere shards are read through
pyarrow's file systems, into memory.

Defined results: null and empty texts are one end token. Without training texts
every token is unknown: the score spreads uniformly over one kind. Ids repeat
harmlessly; a null id counts as an empty text in the choice of training rows. Counts
are whole numbers of 64 bits.
"""

from __future__ import annotations

import contextlib
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import NONSPACE, row_words, shared_dir, slices, tidy
from loamstone.llm.samples import fold

END, BOS, UNK, FIRST = 0, 1, 2, 3
GROUP_BYTES = 6 << 20
#: Words before it (distinct); followers seen once, twice, more often; sum of the followers' own counts.
COLUMNS = ("a", "f1", "f2", "f3", "t")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _write(path: str, arrays: list[np.ndarray]) -> None:
    if at := _local(path):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).data)
        os.replace(part, at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    store.move(part, at)


#: Bytes of shards that a worker keeps in memory where the shared folder isn't mounted.
HELD_BYTES = 256 << 20
_held: dict[str, np.ndarray] = {}


@functools.lru_cache(4096)
def _mapped(at: str, least: int) -> np.ndarray:
    return _whole(np.memmap(at, np.uint8, "r").view(np.ndarray), at, least)


def _whole(raw: np.ndarray, path: str, least: int) -> np.ndarray:
    if len(raw) < least:
        raise OSError(f"{path} holds {len(raw)} bytes of {least}: the shard is cut short")
    return raw


def _map(path: str, least: int) -> np.ndarray:
    """The bytes of a shard, `least` or more: mapped, or read, the last HELD_BYTES of them kept. A shard that is missing or shorter raises."""
    if at := _local(path):
        return _mapped(at, least)
    if path in _held:
        _held[path] = _held.pop(path)
        return _whole(_held[path], path, least)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        raw = _whole(np.frombuffer(f.read(), np.uint8), path, least)
    _held[path] = raw
    while len(_held) > 1 and sum(map(len, _held.values())) > HELD_BYTES:
        del _held[next(iter(_held))]
    return raw


@functools.lru_cache(16)
def _cuts(shards: int) -> np.ndarray:
    """First key of every shard but the first: equal ranges of the 64-bit hashes."""
    return np.array([-(-(s << 64) // shards) for s in range(1, shards)], np.uint64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, by hashing: for values that mostly repeat."""
    coded = pa.array(x).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    return values[order], rank[coded.indices.to_numpy()]


def _packed(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; then the places and values of those of 255 and more."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint64), counts[large].astype(np.uint64)]


def _unpacked(raw: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The counts at some places of n packed ones."""
    out = raw[:n][at].astype(np.int64)
    large = out == 255
    if large.any():
        m = (len(raw) - n) // 16
        held = np.searchsorted(raw[n : n + 8 * m].view(np.uint64), at[large].astype(np.uint64))
        out[large] = raw[n + 8 * m :].view(np.uint64)[held]
    return out


def _squeezed(keys: np.ndarray) -> bytes:
    """Sorted uint64: the first, then differences in as many bytes as the largest needs."""
    step = np.diff(keys)
    width = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    return bytes([width]) + keys[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _full(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    step = np.frombuffer(raw, np.uint8, offset=9)
    out = np.zeros((1 + (len(step) // raw[0] if raw[0] else 0), 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    if raw[0]:
        out[1:, : raw[0]] = step.reshape(-1, raw[0])
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _counts(raw: bytes, n: int) -> np.ndarray:
    return _unpacked(np.frombuffer(raw, np.uint8), n, np.arange(n))


class Table:
    """Shards of sorted uint64 keys, and columns of counts in files of their own."""

    def __init__(self, path: str, sizes: list[int]) -> None:
        self.path = path
        self.base = np.cumsum([0, *sizes])

    def __len__(self) -> int:
        return int(self.base[-1])

    def keys(self, shard: int) -> np.ndarray:
        n = int(self.base[shard + 1] - self.base[shard])
        return _map(f"{self.path}/{shard}", 8 * n)[: 8 * n].view(np.uint64) if n else np.zeros(0, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys; -1: absent."""
        place = np.full(len(keys), -1, np.int64)
        shards = len(self.base) - 1
        cut = np.concatenate([[0], np.searchsorted(keys, _cuts(shards)), [len(keys)]])
        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b, held = int(cut[s]), int(cut[s + 1]), self.keys(s)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
                hit = held[at] == keys[a:b]
                place[a:b][hit] = at[hit] + self.base[s]
        return place

    def _each(self, places: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        cut = np.searchsorted(places, self.base)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(int(cut[s]), int(cut[s + 1]))
            yield s, own, places[own] - self.base[s]

    def column(self, name: str, places: np.ndarray) -> np.ndarray:
        """Counts at sorted places; 0 at places below 0."""
        out = np.zeros(len(places), np.int64)
        for s, own, at in self._each(places):
            n = int(self.base[s + 1] - self.base[s])
            out[own] = _unpacked(_map(f"{self.path}/{s}.{name}", n), n, at)
        return out

    def keys_at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for s, own, at in self._each(places):
            out[own] = self.keys(s)[at]
        return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts, in whole numbers."""
    k = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(k)
    k = k[order]
    first, _ = _runs(k)
    c = np.concatenate([np.zeros(0, np.int64), *counts])[order]
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _groups_of_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about GROUP_BYTES, with their words' hashes and offsets; hashing goes by small slices."""
    for part in slices(batch, "text", GROUP_BYTES):
        words, rows, base = [], [np.zeros(1, np.int64)], 0
        for s in slices(part, "text"):
            w, r = row_words(s.column("text"), NONSPACE)
            words.append(w)
            rows.append(r[1:] + base)
            base += len(w)
        yield part, np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(rows)


def _chunks(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted keys and counts as one row a shard."""
    cut = [0, *np.searchsorted(keys, _cuts(shards)).tolist(), len(keys)]
    return _rows([(s, keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]) for s in range(shards) if cut[s] < cut[s + 1]])


def _rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    shard, keys, counts = zip(*parts, strict=True) if parts else ((), (), ())
    columns = [pa.array(shard, pa.int32()), pa.array([len(k) for k in keys], pa.int32()), pa.array([_squeezed(k) for k in keys], pa.binary()), pa.array([b"".join(x.tobytes() for x in _packed(c)) for c in counts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "size", "k", "n"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each shard, from batches sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield held[0]["shard"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["shard"], held


_CHUNK = "shard int, size int, k binary, n binary"


def _dealt(chunks: DataFrame, parts: int) -> DataFrame:
    """Every shard to the partition of its number; what is not a shard's own (under 0, a few rows) to the first."""
    return chunks.repartitionById(parts, F.greatest("shard", F.lit(0))).sortWithinPartitions("shard")


def _ids(table: Table, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each word."""
    distinct, back = _distinct(words)
    place = table.find(distinct)
    hit = place >= 0
    count = np.zeros(len(distinct), np.int64)
    count[hit] = table.column("n", place[hit])
    return np.where(hit, place + FIRST, UNK)[back], count[back]


def _pack(context: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(bits) | token.astype(np.uint64)) * _ODD


def _unpack(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = keys * _UNDO
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


def _lookup(table: Table, context: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """Place of every (context, token); -1: absent, as with a context of -1."""
    place = np.full(len(token), -1, np.int64)
    some = context >= 0
    keys, back = np.unique(_pack(context[some], token[some], bits), return_inverse=True)
    place[some] = table.find(keys)[back]
    return place


def _longer(place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Contexts one word longer: the n-gram that ends before each token; a text's first token has none."""
    context = np.empty_like(place)
    context[1:] = place[:-1]
    context[at[:-1]] = -1
    return context


def _later(x: np.ndarray, at: np.ndarray, first: float) -> np.ndarray:
    """x one place on, with `first` where a text begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


def _shortened(tables: list[Table], n: int, places: np.ndarray, bits: int) -> np.ndarray:
    """Number of each n-gram without its first word, among those of n - 1 words."""
    distinct, back = np.unique(places, return_inverse=True)
    context, token = _unpack(tables[n - 1].keys_at(distinct), bits)
    if n > 2:
        token = _lookup(tables[n - 2], _shortened(tables, n - 1, context, bits), token, bits)
    return token[back]


def _bigrams(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token numbers of every text's words and end, and offsets of the texts."""
    n = np.diff(rows)
    out = rows + np.arange(len(rows))
    token = np.full(out[-1], END, np.int64)
    inner = np.ones(out[-1], bool)
    inner[out[1:] - 1] = False
    token[inner] = ids
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[out[:-1]] = BOS
    return context, token, out[: len(n) + 1]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


class Model:
    """What scoring needs: where the shards are, their sizes, and a few totals. Small, whatever the corpus."""

    def __init__(self, tables: list[Table], texts: int, tokens: int, bits: int, seen: list[list[int]], special: dict[int, dict[str, int]]) -> None:
        self.tables, self.texts, self.tokens, self.bits, self.special = tables, texts, tokens, bits, special
        self.words, self.order = tables[0], len(tables)
        self.vocabulary = len(self.words) + (1 if texts else 0)
        self.seen = seen
        self.discounts = [_discounts(x[:4]) for x in seen]

    def values(self, n: int, name: str, numbers: np.ndarray) -> np.ndarray:
        """A column of n-grams; numbers sorted."""
        if n > 1:
            return self.tables[n - 1].column(name, numbers)
        k = int(np.searchsorted(numbers, FIRST))
        few = np.array([self.special.get(i, {}).get(name, 0) for i in numbers[:k].tolist()], np.int64)
        return np.concatenate([few, self.words.column(name, numbers[k:] - FIRST)])

    def _shares(self, n: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts of n - 1 words (numbers sorted): the sum of their followers' counts, and the share left to the lower order."""
        total = self.values(n - 1, "n" if n == self.order else "t", numbers).astype(float)
        left = sum(self.discounts[n - 1][k] * self.values(n - 1, f"f{k + 1}", numbers) for k in range(3))
        return total, np.divide(left, total, out=np.ones(len(numbers)), where=total > 0)

    def log10(self, context: np.ndarray, token: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 p(token | up to order - 1 words before it); context: the word before; at: offsets of the texts."""
        w, back = _distinct(token)
        a = self.values(1, "a", w)
        n1, n2, _, _, more, kinds = self.seen[0]
        uniform = 1 / (self.vocabulary + 1)
        if kinds:
            d = self.discounts[0]
            p = np.maximum(a - np.select([a == 1, a == 2, a > 2], d, 0.0), 0) / kinds + (d[0] * n1 + d[1] * n2 + d[2] * more) / kinds * uniform
        else:
            p = np.full(len(w), uniform)
        p = p[back]
        # The context of a token is what ended at the token before it, so its figures are those of there, one place on.
        begin = [float(x[0]) for x in self._shares(2, np.array([BOS]))]
        told = [x[back] for x in self._shares(2, w)]
        for n in range(2, self.order + 1):
            total, left = (_later(x, at, first) for x, first in zip(told, begin, strict=True))
            some = context >= 0
            keys, which = np.unique(_pack(context[some], token[some], self.bits), return_inverse=True)
            found = self.tables[n - 1].find(keys)
            hit = found >= 0
            c = np.zeros(len(keys))
            c[hit] = self.values(n, "n" if n == self.order else "a", found[hit])
            share = np.zeros(len(token))
            share[some] = np.maximum(c - np.select([c == 1, c == 2, c > 2], self.discounts[n - 1], 0.0), 0)[which]
            p = np.divide(share, total, out=np.zeros(len(p)), where=total > 0) + left * p
            if n < self.order:
                told, begin = [], [0.0, 1.0]
                for x, none in zip(self._shares(n + 1, found[hit]), begin, strict=True):
                    each, full = np.full(len(keys), none), np.full(len(token), none)
                    each[hit] = x
                    full[some] = each[which]
                    told.append(full)
                place = np.full(len(token), -1, np.int64)
                place[some] = found[which]
                context = _longer(place, at)
        return np.log10(p)


_MERGED = "shard int, size long, total long, seen array<long>"


def _seen(c: np.ndarray) -> list[int]:
    """Numbers of counts of 1, 2, 3, 4 and over 2, and the sum of all."""
    return [*(int((c == x).sum()) for x in (1, 2, 3, 4)), int((c > 2).sum()), int(c.sum())]


def _report(shard: int, size: int, total: int, seen: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([total], pa.int64()), pa.array([seen], pa.list_(pa.int64()))], names=["shard", "size", "total", "seen"])


@contextlib.contextmanager
def _let_go(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of queries made within once they end: their results lie in the shared folder by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame, *, text_col: str = "text", order: int = 2) -> Model:
    """A model of n-grams up to the order (2 at least), counted over all rows of docs."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("text"))

    def merge(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, held in _by_shard(batches):
                k, c = _merged([_full(r["k"]) for r in held], [_counts(r["n"], r["size"]) for r in held])
                _write(f"{folder}/{shard}", [k])
                _write(f"{folder}/{shard}.n", _packed(c))
                yield _report(shard, len(k), int(c.sum()), _seen(c))

        return run

    def counted(keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], folder: str) -> tuple[Table, int, list[int]]:
        """Table of the keys of all texts, their number with repeats, and numbers of counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, counts = [], []
                for _, w, rows in _groups_of_slices(batch):
                    k, c = np.unique(keys_of(w, rows), return_counts=True)
                    keys.append(k)
                    counts.append(c)
                if keys:
                    yield _chunks(*_merged(keys, counts), parts)

        sizes, total, seen = [0] * parts, 0, [0] * 6
        with _let_go(spark):
            told = _dealt(texts.mapInArrow(tidy(run), _CHUNK), parts).mapInArrow(tidy(merge(folder)), _MERGED).collect()
        for r in told:
            sizes[r.shard], total, seen = r.size, total + r.total, [x + y for x, y in zip(seen, r.seen, strict=True)]
        return Table(folder, sizes), total, seen

    words, n_words, _ = counted(lambda w, rows: w, f"{path}/1")
    n_texts = texts.count()
    if len(words) + FIRST >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: numbers of words no longer pack in pairs")
    bits, tables = (len(words) + FIRST).bit_length(), [words]
    seen: list[list[int]] = [[0] * 6 for _ in range(order)]

    def grams(w: np.ndarray, rows: np.ndarray, tables: list[Table]) -> np.ndarray:
        context, token, at = _bigrams(_ids(words, w)[0], rows)
        for table in tables[1:]:
            context = _longer(_lookup(table, context, token, bits), at)
        some = context >= 0
        return _pack(context[some], token[some], bits)

    for n in range(2, order + 1):
        table, _, seen[n - 1] = counted(functools.partial(grams, tables=list(tables)), f"{path}/{n}")
        if n < order and len(table) >= 1 << (64 - bits):
            raise ValueError(f"more than 2**{64 - bits} distinct {n}-grams: their numbers no longer pack with those of words")
        tables.append(table)

    def stats(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """What the n-grams of a shard say of those of n - 1 words, to their shards (-1: special words)."""
        own, below = tables[n - 1], tables[n - 2]
        first = 0 if n > 2 else FIRST

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in (s for batch in batches for s in batch.column(0).to_pylist()):
                context, token = _unpack(own.keys(shard), bits)
                c = own.column("n" if n == order else "a", np.arange(own.base[shard], own.base[shard + 1]))
                short = token if n == 2 else _lookup(below, _shortened(tables, n - 1, context, bits), token, bits)
                told = [np.unique(x, return_counts=True) for x in (short, context[c == 1], context[c == 2], context[c > 2])]
                if n < order:
                    i, total = _merged([context.astype(np.uint64)], [c])
                    told.append((i.astype(np.int64), total))
                i, column, value = (np.concatenate(x) for x in zip(*((i, np.full(len(i), k), v) for k, (i, v) in enumerate(told)), strict=True))
                at = np.searchsorted(below.base + first, i, side="right") - 1
                # Places within the shard and columns, in one uint64.
                code = (i - np.where(at >= 0, below.base[at] + first, 0)).astype(np.uint64) << np.uint64(3) | column.astype(np.uint64)
                by = np.lexsort((code, at))
                at, code, value = at[by], code[by], value[by]
                sent = [(int(at[s]), code[s:e], value[s:e]) for s, e in zip(*(x.tolist() for x in _runs(at)), strict=True)]
                # Each shard below hears of itself, even if no n-gram names it.
                yield _rows([*sent, (shard, code[:0], value[:0])])

        return run

    def gather(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        own = tables[n - 1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, held in _by_shard(batches):
                size = FIRST if shard < 0 else int(own.base[shard + 1] - own.base[shard])
                out = np.zeros((5, size), np.int64)
                for r in held:
                    k = _full(r["k"])
                    out[(k & np.uint64(7)).astype(int), (k >> np.uint64(3)).astype(int)] += _counts(r["n"], r["size"])
                if n > 1:
                    # Only what begins a text has nothing before it.
                    out[0] = np.where(out[0] > 0, out[0], own.column("n", np.arange(own.base[shard], own.base[shard + 1])))
                if shard >= 0 and size:
                    for name, c in zip(COLUMNS if n < order - 1 else COLUMNS[:4], out, strict=False):
                        _write(f"{own.path}/{shard}.{name}", _packed(c))
                yield _report(shard, size, 0, _seen(out[0]) + (out.T.ravel().tolist() if shard < 0 else []))

        return run

    special: dict[int, dict[str, int]] = {}
    for n in range(order, 1, -1):
        seen[n - 2] = [0] * 6
        with _let_go(spark):
            told = _dealt(spark.range(0, parts, 1, parts).mapInArrow(tidy(stats(n)), _CHUNK), parts).mapInArrow(tidy(gather(n - 1)), _MERGED).collect()
        for r in told:
            seen[n - 2] = [x + y for x, y in zip(seen[n - 2], r.seen[:6], strict=True)] if r.size else seen[n - 2]
            if r.shard < 0:
                special = {k: dict(zip(COLUMNS, r.seen[6 + 5 * k : 11 + 5 * k], strict=True)) for k in range(FIRST)}
    special.setdefault(BOS, {})["n"] = n_texts
    return Model(tables, n_texts, n_words + n_texts, bits, seen, special)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(at):
        return np.zeros(0, int), np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.r_[first[1:], len(at)]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = model.tokens, model.vocabulary
        for batch in batches:
            for part, words, rows in _groups_of_slices(batch):
                ids, count = _ids(model.words, words)
                context, token, at = _bigrams(ids, rows)
                c = np.empty(len(token), np.int64)
                ends = np.zeros(len(token), bool)
                ends[at[1:] - 1] = True
                c[~ends] = count
                c[ends] = model.texts
                base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
                best = model.log10(context, token, at)
                size = np.diff(at)
                s = np.add.reduceat(best, at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), at[:-1])), pa.array(np.full(len(size), total)), pa.array(np.add.reduceat(base, at[:-1])), pa.array(s), pa.array(10 ** np.minimum(-s / size, 300))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out_tenth(id_col: str = "doc_id") -> Column:
    return fold(id_col, 10) == 0
