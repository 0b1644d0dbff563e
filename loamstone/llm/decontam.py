"""Benchmark decontamination with a generalised suffix automaton over words.

Test items are normalised (A-Z lowered, words of letters, digits and non-ASCII
characters) and indexed, item after item, in one suffix automaton whose letters
are word numbers. Training texts stream through it; at every word the automaton
knows the length of the longest match that ends there. A match of `window`
words, or a whole shorter item, marks its words as hit.

The automaton is built on the driver from the benchmark alone, in blocks of at
most `block_words` words (and one item). A benchmark of one block takes one pass over
the texts. A larger one takes a pass for each block, one after the other: the hits so
far lie beside the rows in the shared folder, and a block is built when its pass begins
and given up when it ends, so driver and workers hold one block whatever the
benchmark's size; no block is dropped.

Defined results: a null or wordless text has no words, no hits and is clean. An
item without words never occurs. Repeated items both count. Items with a null id hit
like others; together they are one null at the end of `items`, which n_items counts
and the digest leaves out, as the SQL does. Rows are judged one
by one, so repeated ids and null ids are harmless, and all other columns pass
through untouched.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import ALNUM, discard, fresh, lowered, row_words, slices, span_hashes, stored, text_buffer, tidy, word_spans

WINDOW = 13
#: A document is contaminated from one word in so many.
COVERAGE = 20
BLOCK_WORDS = 500_000


class Automaton:
    """Generalised suffix automaton; states know the items of their longest windows.

    It is built in dicts, on the driver, and then kept in flat arrays, which is what workers
    get: transitions sorted by state and word, and lists of items by state. A block of
    500,000 words takes some 50 MB so, of which a worker holds one copy.
    """

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: For each state: the state of the window that ends a match there (-1: none).
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.full = array("i", [-1]) * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.full[s] = self.full[up] if self.length[up] >= window else (s if self.length[s] >= window else -1)
        #: Numbers of items by name, those of each window's state, and of short items (state, words); each state also points to the nearest short item's state above it.
        self.names = list(dict.fromkeys(name for name, _ in items))
        number = {name: k for k, name in enumerate(self.names)}
        owners: set[tuple[int, int]] = set()
        short: set[tuple[int, int, int]] = set()
        for name, words in items:
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                short.add((s, len(words), number[name]))
                continue
            s = n = 0
            for w in words:
                s, n = self._step(s, n, w)
                if n >= window:
                    owners.add((self.full[s], number[name]))
        rows = sorted(owners)
        self.owner_from, self.owner = self._by_state([s for s, _ in rows]), array("i", [k for _, k in rows])
        rows = sorted(short)
        self.short_from, self.short_words, self.short = self._by_state([s for s, _, _ in rows]), array("i", [n for _, n, _ in rows]), array("i", [k for _, _, k in rows])
        self.above = array("i", [-1]) * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.above[s] = up if self.short_from[up] < self.short_from[up + 1] else self.above[up]
        self._flatten()

    def _by_state(self, states: list[int]) -> array:
        """Where each state's rows begin, of rows sorted by state."""
        return array("i", np.searchsorted(np.array(states, np.int64), np.arange(len(self.link) + 1)).astype(np.int32).tobytes())

    def _flatten(self) -> None:
        """Transitions as arrays; those of the first state by word, as it has one for every word."""
        self.root = array("i", [-1]) * (max(self.next[0], default=-1) + 1)
        for w, to in self.next[0].items():
            self.root[w] = to
        self.edge_from, self.edge, self.edge_to = array("i", [0, 0]), array("i"), array("i")
        for s in range(1, len(self.next)):
            held = self.next[s]
            for w in sorted(held) if len(held) > 1 else held:
                self.edge.append(w)
                self.edge_to.append(held[w])
            self.edge_from.append(len(self.edge))
            self.next[s] = None
        del self.next

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """While it is built."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit word ranges (start, end), in order of end, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        root, edge_from, edge, edge_to = self.root, self.edge_from, self.edge, self.edge_to
        link, size, full, above, short_from = self.link, self.length, self.full, self.above, self.short_from
        state = length = 0
        for i, w in enumerate(words, 1):
            while state:
                lo, hi = edge_from[state], edge_from[state + 1]
                at = lo if hi - lo == 1 else bisect_left(edge, w, lo, hi)
                if at < hi and edge[at] == w:
                    state, length = edge_to[at], length + 1
                    break
                state = link[state]
                length = size[state]
            else:
                state = root[w]
                if state < 0:
                    state = length = 0
                    continue
                length = 1
            if length >= self.window:
                spans.append((i - self.window, i))
                s = full[state]
                found.update(self.owner[self.owner_from[s] : self.owner_from[s + 1]])
            if self.short:
                s = state if short_from[state] < short_from[state + 1] else above[state]
                while s >= 0:
                    for k in range(short_from[s], short_from[s + 1]):
                        n = self.short_words[k]
                        if n <= length:
                            spans.append((i - n, i))
                            found.add(self.short[k])
                    s = above[s]
        return spans, {self.names[k] for k in found}


class Index:
    """One block of test items: hash of each of their words -> number, and the automaton."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.hashes = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.least = min([window, *(len(w) for _, w in items if len(w))])
        self.automaton = Automaton([(k, np.searchsorted(self.hashes, w).tolist()) for k, w in items], window)

    def matches(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """Row, hit ranges of word numbers within all words, items; only for rows with a hit."""
        if not len(self.hashes) or not len(words):
            return
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == words
        # Only runs of known words can match; none may cross a row.
        edge = np.zeros(len(words) + 1, bool)
        edge[rows] = True
        begin = np.flatnonzero(known & (edge[:-1] | np.r_[True, ~known[:-1]]))
        end = np.flatnonzero(known & (edge[1:] | np.r_[~known[1:], True])) + 1
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        row = np.searchsorted(rows, begin, side="right") - 1
        for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
            spans, found = self.automaton.scan(at[b:e].tolist())
            if spans:
                yield r, [(b + x, b + y) for x, y in spans], found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _item_blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Normalised test items, about block_words words at a time; one block at least. Rows come to the driver as they are asked for."""
    held: list[tuple[str | None, np.ndarray]] = []
    size, some = 0, False
    rows = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        words, _ = row_words(pa.array([r.t]), ALNUM)
        if held and size + len(words) > block_words:
            yield held
            held, size, some = [], 0, True
        held.append((r.k, words))
        size += len(words)
    if held or not some:
        yield held


def build_index(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the blocks of the normalised test items, one by one."""
    for items in _item_blocks(benchmark, block_words, id_col, text_col):
        yield Index(items, window)


FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("contaminated", T.BooleanType())]


_HITS = T.StructType([T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_HITS = pa.struct([("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, action: str = "mark", text_col: str = "text", drop_from: float = 1.0) -> DataFrame:
    """Judge every whole text against every test item.

    action "mark" adds n_words, n_hit, items and contaminated (columns of these
    names are replaced); "drop" returns the clean rows with their own columns;
    "excise" cuts the hit spans out of the texts of contaminated rows and leaves out
    rows of which at least the share drop_from of the words is hit.
    """
    spark = docs.sparkSession
    added = [n for n, _ in FIELDS]
    base = docs.drop(*added) if action == "mark" else docs
    kept = base.columns
    carried = fresh("__hits", base)
    plain = T.StructType(base.schema.fields)

    def scan(batch: pa.RecordBatch, block: Index) -> tuple:
        """Words of a batch, and the hit ranges and items of its rows, those carried along included."""
        data, offsets = text_buffer(batch.column(text_col))
        low = lowered(data)
        starts, ends, rows = word_spans(low, offsets, ALNUM)
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str | None]] = {}
        if carried in batch.schema.names:
            for r, x in enumerate(batch.column(carried).to_pylist()):
                if x["spans"]:
                    b = int(rows[r])
                    spans[r] = [(b + s, b + e) for s, e in zip(x["spans"][::2], x["spans"][1::2], strict=True)]
                    found[r] = set(x["items"])
        for r, some, hits in block.matches(span_hashes(low, starts, ends), rows):
            spans.setdefault(r, []).extend(some)
            found.setdefault(r, set()).update(hits)
        return data, offsets, starts, ends, rows, {r: _merged(x) for r, x in spans.items()}, found

    def carry(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    *_, rows, spans, found = scan(batch, block.value)
                    hits = [{"spans": [x - int(rows[r]) for span in spans.get(r, ()) for x in span], "items": list(found.get(r, ()))} for r in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hits, _ARROW_HITS)], names=[*kept, carried])

        return run

    def judge(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    data, offsets, starts, ends, rows, spans, found = scan(batch, block.value)
                    n = np.diff(rows)
                    hit, items = np.zeros(len(n), np.int64), [[] for _ in n]
                    for r in spans:
                        hit[r] = sum(e - s for s, e in spans[r])
                        items[r] = sorted(found[r], key=lambda k: (k is None, k or ""))
                    bad = (hit > 0) & (coverage * hit >= n)
                    own = batch.select(kept)
                    if action == "mark":
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(bad)], names=[*kept, *added])
                    elif action == "drop":
                        yield own.filter(pa.array(~bad))
                    else:
                        texts = own.column(text_col).to_pylist()
                        for r in np.flatnonzero(bad).tolist():
                            raw, at = data[offsets[r] : offsets[r + 1]].tobytes(), offsets[r]
                            keep, left = [], 0
                            for s, e in spans[r]:
                                keep.append(raw[left : starts[s] - at])
                                left = ends[e - 1] - at
                            texts[r] = b"".join([*keep, raw[left:]]).decode()
                        k = own.schema.get_field_index(text_col)
                        cut = own.set_column(k, own.schema.field(k), pa.array(texts, own.schema.field(k).type))
                        yield cut.filter(pa.array(~bad | (hit < drop_from * n)))

        return run

    blocks = _item_blocks(benchmark, block_words, "item_id", "text")
    items, held = next(blocks), base
    while True:
        index, items = spark.sparkContext.broadcast(Index(items, window)), next(blocks, None)
        if items is None:
            break
        before, held = held, stored(held.mapInArrow(tidy(carry(index)), T.StructType([*plain.fields, T.StructField(carried, _HITS)])), "decontam-hits")
        index.destroy()
        if before is not base:
            discard(before)
    schema = T.StructType([*plain.fields, *(T.StructField(n, k) for n, k in FIELDS)]) if action == "mark" else plain
    return held.mapInArrow(tidy(judge(index)), schema)


def digest(items: DataFrame) -> DataFrame:
    """The contract's digest columns from the operator's `items`."""
    joined = F.array_join("items", ",")
    return items.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(joined, 256)})


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
