"""A stored inverted index with positions, for ranked and phrase search.

Layout below one folder, every part of it Parquet but for the manifest of versions:

    segments/<name>/docs                 range, doc_id, len
    segments/<name>/blocks/bucket=<b>    term, range, first, n, gaps, tfs, lens, best_tf, best_len, positions
    gone/<name>                          segment, range, doc_id: documents deleted or replaced later

Words are dealt to BUCKETS folders by hash and lie sorted in them, so a search opens the folders of its own words
and, in them, skips the row groups of others. Document ids are cut into ranges of about
RANGE_DOCS; the postings of a word in a range are blocks of BLOCK in order of id, ids as gaps. A block
has, for each count in it, the least length of such a document, so its best possible weight is known
under any statistics, also those of later additions.

Search. Blocks of the queries' words go to one task a range, whatever the number of queries, where
all queries meet them. A query's blocks cut the range into windows; the sum of best weights bounds a
window, and windows are scored from the highest bound down until the bound is under the k-th best score so
far. What is left is not scored. Each task hands on k documents a query.

Changes. `add` writes a new segment and marks older versions of its documents as gone, `delete` only
marks; both count once a version of the manifest names them, so a failed or repeated attempt changes
nothing. Counts and mean length are those of the documents that are left; document frequencies too, for which
postings of ranges with deletions are looked through. `merge` rewrites all that is left as one segment.

Defined results: rows with a null id can't be named as a hit and are left out, as are documents without
words. Ids must be unique within one addition (ValueError). Queries with a null id, a null text or no
known word have no hits.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.functions.text import tokenize
from loamstone.operators.batches import WORDS, pieces
from loamstone.operators.lexical import SCORE_DIGITS, TERMS, _query_index, query_terms, ranked
from loamstone.operators.vectors import Best
from loamstone.sources.manifest import Manifest
from loamstone.sources.tables import broadcast_if_small, small_enough

BUCKETS, BLOCK, RANGE_DOCS, MOST_RANGES = 64, 128, 16_384, 8_192
#: Postings a file holds about, and words that are looked for by name in the row groups.
FILE_POSTINGS, NAMED = 20_000_000, 500
#: Postings of a query in a range under which all of them are scored at once.
FEW = 2_048
#: Tasks that what is left of a range with deletions is dealt to, by word, as it is merged.
SHARES = 8
#: Places in texts that are put in order at once.
MOST_PLACES = 2_000_000
#: Rows on their way to blocks: words of a bucket in a range, in each how many postings, and these, all as bytes; or, without a bucket, documents and their lengths.
_PART = "bucket int, range int, words binary, ends binary, counts binary, ids binary, tfs binary, lens binary, positions binary, docs binary, sizes binary"
_NAMES = [c.split()[0] for c in _PART.split(", ")]
_LENGTH = "range int, doc_id long, len int"
#: Of what is stored; from 2 on words are dealt by crc32.
LAYOUT = 2
_BLOCK = "bucket int, term string, range int, first long, n int, gaps array<long>, tfs array<int>, lens array<int>, best_tf array<int>, best_len array<int>, positions array<int>"
_GONE = "segment string, range int, doc_id long"
Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bucket_of(term: str = "term"):
    """The same as `_buckets`."""
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(BUCKETS)).cast("int")


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64) % buckets


def _list(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def _begins(*keys: np.ndarray) -> np.ndarray:
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1 .. of each run of such a size, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _bytes(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    """values[cut[0]:cut[1]], values[cut[1]:cut[2]] .. as the bytes of their numbers."""
    ends = np.ascontiguousarray(cut * values.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the rows of `_bytes`, one row after the other, and where each row begins and the last ends."""
    held = column.cast(pa.binary())
    _, ends, values = held.buffers()
    ends = np.frombuffer(ends, np.int32)[held.offset : held.offset + len(held) + 1]
    wide = np.dtype(kind).itemsize
    return np.frombuffer(values or b"", np.uint8)[ends[0] : ends[-1]].view(kind), (ends - ends[0]).astype(np.int64) // wide


def _sorted(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by two keys, the first of them not negative; as one number with its place where that fits 64 bits."""
    n, low = len(first), int(second.min())
    wide, place = (int(second.max()) - low).bit_length(), n.bit_length()
    if int(first.max()).bit_length() + wide + place > 63:
        return np.lexsort((second, first))
    key = (((first << wide) | (second - low)) << place) | np.arange(n)
    key.sort()
    return key & ((1 << place) - 1)


def _part(words: pa.Array, bucket: np.ndarray, ranges: np.ndarray, group: np.ndarray, word: np.ndarray, doc: np.ndarray, size: np.ndarray, tf: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Postings in order of group, word and document as a row for each group, whose bucket and range are those of its first posting.

    words: texts of the numbers in `word`; bucket: of each of these; ranges: of each posting.
    """
    head, begin = _begins(group), _begins(group, word)
    cut = np.r_[head, len(doc)]
    of_words = np.searchsorted(begin, cut)
    held = words.take(pa.array(word[begin])).cast(pa.string())
    _, ends, text = held.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(held) + 1]
    numbers = lambda at, v: _bytes(at, v.astype(np.int32))
    columns = [
        pa.array(bucket[word[head]].astype(np.int32)), pa.array(ranges[head].astype(np.int32)), _bytes(ends[of_words], np.frombuffer(text or b"", np.uint8)), numbers(of_words, np.diff(ends)), numbers(of_words, np.diff(np.r_[begin, len(doc)])),
        _bytes(cut, doc), numbers(cut, tf), numbers(cut, size), numbers(np.r_[0, np.cumsum(tf, dtype=np.int64)][cut], places), *[pa.nulls(len(head), pa.binary())] * 2,
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _parts(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """The postings of up to a million words as a row for each bucket and range, and rows without a bucket that have the documents and their lengths."""
    buckets = BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for piece in (piece for whole in batches for piece in pieces(whole, "w", WORDS)):
            ids = piece.column("doc_id").to_numpy()
            if (ids[1:] < ids[:-1]).any():
                piece = piece.take(pa.array(np.argsort(ids)))
                ids = piece.column("doc_id").to_numpy()
            words = piece.column("w")
            size, coded = np.diff(words.offsets.to_numpy()), words.flatten().dictionary_encode()
            n, ranges = len(coded), np.searchsorted(edges, ids, side="right")
            if not n:
                continue
            bucket = _buckets(coded.dictionary, buckets)
            # One number holds bucket, range, word and place, so sorting needs no further key.
            of_range, of_word, of_place = (int(x).bit_length() for x in (ranges[-1] - ranges[0], len(bucket), n))
            of_row = np.repeat(np.arange(len(ids)), size)
            code = coded.indices.to_numpy()
            key = ((bucket << (of_range + of_word)) | np.arange(len(bucket)))[code] | ((ranges - ranges[0]) << of_word)[of_row]
            key = (key << of_place) | np.arange(n)
            key.sort()
            at, key = key & ((1 << of_place) - 1), key >> of_place
            row = of_row[at]
            begin = _begins(key, row)
            owner, key = row[begin], key[begin]
            places = (np.arange(n) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size))[at]
            yield _part(coded.dictionary, bucket, ranges[owner], key >> of_word, key & ((1 << of_word) - 1), ids[owner], size[owner], np.diff(np.r_[begin, n]), places)
            has = np.flatnonzero(size)
            head = _begins(ranges[has])
            cut, none = np.r_[head, len(has)], [pa.nulls(len(head), pa.binary())] * 7
            columns = [pa.nulls(len(head), pa.int32()), pa.array(ranges[has][head].astype(np.int32)), *none, _bytes(cut, ids[has]), _bytes(cut, size[has].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return docs.mapInArrow(run, _PART)


def _lengths(parts: DataFrame) -> DataFrame:
    """range, doc_id, len from the rows of `_parts` that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, cut = _numbers(batch.column("docs"), np.int64)
                size, _ = _numbers(batch.column("sizes"), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("range").to_numpy(), np.diff(cut))), pa.array(ids), pa.array(size)], names=["range", "doc_id", "len"])

    return parts.where("docs is not null").select("range", "docs", "sizes").mapInArrow(run, _LENGTH)


def _cuts(ids: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about RANGE_DOCS (more from MOST_RANGES ranges on)."""
    ranges = min(-(-ids.count() // RANGE_DOCS), MOST_RANGES)
    return sorted({int(c) for c in ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []


def _blocks(parts: DataFrame, files: int) -> DataFrame:
    """Postings, dealt by bucket and range, as blocks sorted by word."""

    def blocks(bucket: int, number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        numbers = lambda c, kind=np.int32: _numbers(rows.column(c).combine_chunks(), kind)[0]
        ends = np.r_[0, np.cumsum(numbers("ends"), dtype=np.int64)].astype(np.int32)
        coded = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(numbers("words", np.uint8))).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        word = np.repeat(rank[coded.indices.to_numpy()], numbers("counts"))
        ids, tf, size = numbers("ids", np.int64), numbers("tfs"), numbers("lens")
        order = _sorted(word, ids)
        start = (np.cumsum(tf, dtype=np.int64) - tf)[order]
        word, ids, tf, size = word[order], ids[order], tf[order], size[order]
        places = numbers("positions")[_spread(start, tf.astype(np.int64))]
        runs = _begins(word)
        within = _spread(np.zeros(len(runs), np.int64), np.diff(np.r_[runs, len(ids)]))
        begin = np.flatnonzero(within % BLOCK == 0)
        cut = np.r_[begin, len(ids)]
        gaps = np.diff(ids, prepend=ids[:1])
        gaps[begin] = 0
        block = np.repeat(np.arange(len(begin)), np.diff(cut))
        order = np.lexsort((size, tf, block))
        best = order[_begins(block[order], tf[order])]
        best_cut = np.searchsorted(block[best], np.arange(len(begin) + 1))
        same = lambda v: pa.array(np.full(len(begin), v, np.int32))
        return pa.RecordBatch.from_arrays(
            [
                same(bucket), coded.dictionary.take(by_name.take(pa.array(word[begin]))), same(number), pa.array(ids[begin]), pa.array(np.diff(cut).astype(np.int32)),
                _list(cut, gaps, pa.int64()), _list(cut, tf, pa.int32()), _list(cut, size, pa.int32()),
                _list(best_cut, tf[best], pa.int32()), _list(best_cut, size[best], pa.int32()), _list(np.r_[0, np.cumsum(tf, dtype=np.int64)][cut], places, pa.int32()),
            ],
            names=["bucket", "term", "range", "first", "n", "gaps", "tfs", "lens", "best_tf", "best_len", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, places = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(_numbers(batch.column("positions"), np.int32)[1]).tolist()
            for k, key in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("range").to_pylist(), strict=True)):
                # A bucket's part of a range of very long texts goes in several times; its blocks are then more, and overlap.
                if held and (key != now or places + size[k] > MOST_PLACES):
                    yield blocks(*now, held)
                    held, places = [], 0
                now, places = key, places + size[k]
                held.append(batch.slice(k, 1))
        if held:
            yield blocks(*now, held)

    dealt = parts.repartition("bucket", F.pmod("range", F.lit(files))).sortWithinPartitions("bucket", "range")
    return dealt.drop("docs", "sizes").mapInArrow(run, _BLOCK).sortWithinPartitions("bucket", "term", "range", "first")


def _ids(first: np.ndarray, n: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Ids of the documents of blocks, one block after the other."""
    run = np.cumsum(gaps)
    return run + np.repeat(first - run[np.cumsum(n) - n], n)


class _Range:
    """The blocks of some words in one range of documents, decoded; places of a block's postings are ptr[b] to ptr[b + 1]."""

    def __init__(self, table: pa.Table, term: np.ndarray, gone: np.ndarray, positions: bool = False) -> None:
        order = np.lexsort((table.column("first").to_numpy(), term))
        held, self.term = table.take(order), term[order]
        column = lambda c: held.column(c).combine_chunks()
        self.n = column("n").to_numpy().astype(np.int64)
        self.ptr = np.r_[0, np.cumsum(self.n)]
        first = column("first").to_numpy()
        self.doc = _ids(first, self.n, column("gaps").flatten().to_numpy())
        self.first, self.last = first, self.doc[self.ptr[1:] - 1]
        self.tf, self.len = column("tfs").flatten().to_numpy(), column("lens").flatten().to_numpy()
        self.ids = self.own = None
        self.live = np.ones(len(self.doc), bool) if not len(gone) else ~np.isin(self.doc, gone)
        if positions:
            self.places, self.place_ptr = column("positions").flatten().to_numpy(), np.r_[0, np.cumsum(self.tf.astype(np.int64))]
        else:
            best = column("best_tf")
            self.best_ptr = np.r_[0, np.cumsum(np.diff(best.offsets.to_numpy()))]
            self.best_tf, self.best_len = best.flatten().to_numpy(), column("best_len").flatten().to_numpy()

    def bounds(self, weigh: Weigh) -> np.ndarray:
        """The best weight of a posting in each block."""
        term = np.repeat(self.term, np.diff(self.best_ptr))
        return np.maximum.reduceat(weigh(term, self.best_tf, self.best_len), self.best_ptr[:-1]) if len(self.term) else np.zeros(0)

    def scores(self, blocks: np.ndarray, weigh: Weigh) -> tuple[np.ndarray, np.ndarray]:
        """Live documents of some blocks and the sums of their weights there."""
        at = _spread(self.ptr[blocks], self.n[blocks])
        at = at[self.live[at]]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        if self.ids is None:  # numbered once for all queries, so sums need no sort
            self.ids, own = np.unique(self.doc, return_inverse=True)
            self.own = own.astype(np.int32)
        own = self.own[at]
        score = np.bincount(own, weigh(self._term_of(blocks, at), self.tf[at], self.len[at]), len(self.ids))
        found = np.flatnonzero(np.bincount(own, minlength=len(self.ids)))
        return self.ids[found], score[found]

    def _term_of(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.term[np.searchsorted(self.ptr, at, side="right") - 1]


def best_of_range(part: _Range, blocks: np.ndarray, bounds: np.ndarray, weigh: Weigh, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and rounded scores that hold the k best of one query over these blocks, if over `least`; and how many blocks were scored.

    least: a score that k documents elsewhere already reach.
    """
    slack = 10.0**-SCORE_DIGITS
    if part.n[blocks].sum() <= FEW:
        doc, score = part.scores(blocks, weigh)
        return doc, np.round(score, SCORE_DIGITS), len(blocks)
    edges = np.unique(np.r_[part.first[blocks], part.last[blocks] + 1])
    from_, to = np.searchsorted(edges, part.first[blocks]), np.searchsorted(edges, part.last[blocks] + 1)
    change = np.zeros(len(edges))
    np.add.at(change, from_, bounds[blocks])
    np.add.at(change, to, -bounds[blocks])
    window = np.cumsum(change)[:-1]
    order = np.argsort(-window, kind="stable")
    found_doc, found, scored = [], [], np.zeros(len(blocks), bool)
    done, step = 0, 8
    while done < len(order) and window[order[done]] >= least - 2 * slack:
        now = order[done : done + step]
        now = now[window[now] >= least - 2 * slack]
        taken = np.zeros(len(edges), np.int64)
        taken[now] = 1
        held = np.r_[0, np.cumsum(taken)]
        own = held[to] > held[from_]
        scored |= own
        doc, score = part.scores(blocks[own], weigh)
        inside = taken[np.searchsorted(edges, doc, side="right") - 1] > 0
        found_doc.append(doc[inside])
        found.append(np.round(score[inside], SCORE_DIGITS))
        every = np.concatenate(found)
        if len(every) >= k:
            least = max(least, float(np.partition(every, -k)[-k]))
        done, step = done + step, step * 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), 0
    return np.concatenate(found_doc), np.concatenate(found), int(scored.sum())


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)
        #: Blocks that searches of this object have read and scored.
        self.read, self.scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    # State: segments (names), gone (names), docs and words (of what is left).
    def _state(self) -> tuple[int, dict]:
        version, held = self.manifest.last()
        if held and held.get("layout") != LAYOUT:
            raise ValueError(f"the index at {self.path} has another layout; build it anew")
        return version, held or {"layout": LAYOUT, "segments": [], "gone": [], "docs": 0, "words": 0}

    def _docs(self, held: dict) -> DataFrame:
        """segment, range, doc_id, len of all documents that are left."""
        parts = [self.spark.read.schema(_LENGTH).parquet(f"{self.path}/segments/{s}/docs").withColumn("segment", F.lit(s)) for s in held["segments"]]
        if not parts:
            return self.spark.createDataFrame([], "range int, doc_id long, len int, segment string")
        every = reduce(DataFrame.unionByName, parts)
        return every.join(self._gone(held), ["segment", "range", "doc_id"], "left_anti") if held["gone"] else every

    def _gone(self, held: dict) -> DataFrame:
        paths = [f"{self.path}/gone/{g}" for g in held["gone"]]
        return self.spark.read.schema(_GONE).parquet(*paths) if paths else self.spark.createDataFrame([], _GONE)

    def _mark(self, held: dict, ids: DataFrame) -> tuple[dict, str | None]:
        """The state without the documents of these ids (doc_id, distinct), and the new folder of marks, if any is needed."""
        name = uuid.uuid4().hex
        left = self._docs(held).join(ids, "doc_id", "left_semi")
        left.select("segment", "range", "doc_id", "len").write.parquet(f"{self.path}/gone/{name}")
        n, words = self.spark.read.schema(_GONE + ", len int").parquet(f"{self.path}/gone/{name}").agg(F.count("*"), F.sum("len")).first()
        if not n:
            self.manifest.store.delete(f"gone/{name}")
            return held, None
        return held | {"gone": [*held["gone"], name], "docs": held["docs"] - n, "words": held["words"] - words}, name

    def _segment(self, name: str, docs: DataFrame, parts: DataFrame) -> tuple[int, int]:
        """Write a segment of documents (range, doc_id, len) and rows of words: how many documents and words it has."""
        at = f"{self.path}/segments/{name}"
        docs.write.parquet(f"{at}/docs")
        n, words = self.spark.read.schema(_LENGTH).parquet(f"{at}/docs").agg(F.count("*"), F.sum("len")).first()
        files = max(1, -(-(words or 0) // (FILE_POSTINGS * BUCKETS)))
        _blocks(parts, files).write.partitionBy("bucket").parquet(f"{at}/blocks")
        return n, words or 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index documents; those of ids that are there replace them, also by nothing where they have no words. Returns the version."""
        new = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(tokenize(F.col(f"`{text_col}`")), F.array().cast("array<string>")).alias("w")).where("doc_id is not null")
        ids = new.select("doc_id")
        if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("ids must be unique within one addition")
        name = uuid.uuid4().hex
        _parts(new, _cuts(ids)).write.parquet(f"{self.path}/segments/{name}/parts")
        parts = self.spark.read.schema(_PART).parquet(f"{self.path}/segments/{name}/parts")
        n, words = self._segment(name, _lengths(parts), parts.where("bucket is not null"))
        self.manifest.store.delete(f"segments/{name}/parts")
        while True:
            version, held = self._state()
            left, marks = self._mark(held, ids) if held["segments"] else (held, None)
            if not n:
                self.manifest.store.delete(f"segments/{name}")
            after = left | {"segments": [*left["segments"], *([name] if n else [])], "docs": left["docs"] + n, "words": left["words"] + words}
            if self.manifest.publish(version + 1, after):
                return version + 1
            if marks:
                self.manifest.store.delete(f"gone/{marks}")

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Take documents out. Returns the version."""
        wanted = ids.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        while True:
            version, held = self._state()
            after, marks = self._mark(held, wanted)
            if self.manifest.publish(version + 1, after):
                return version + 1
            if marks:
                self.manifest.store.delete(f"gone/{marks}")

    def merge(self) -> bool:
        """Rewrite what is left as one segment and drop what it replaces; False, with nothing changed, if another change came first."""
        version, held = self._state()
        if not held["segments"]:
            return False
        name, left = uuid.uuid4().hex, self._docs(held)
        cuts = _cuts(left.select("doc_id"))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges = np.array(cuts, np.int64)
            for batch in batches:
                ranges = np.searchsorted(edges, batch.column("doc_id").to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ranges), batch.column("doc_id"), batch.column("len")], names=["range", "doc_id", "len"])

        n, _ = self._segment(name, left.select("doc_id", "len").mapInArrow(again, _LENGTH), self._left(held, cuts))
        if not self.manifest.publish(version + 1, held | {"segments": [name] if n else [], "gone": []}):
            self.manifest.store.delete(f"segments/{name}")
            return False
        for old in [f"segments/{s}" for s in held["segments"]] + [f"gone/{g}" for g in held["gone"]] + ([] if n else [f"segments/{name}"]):
            self.manifest.store.delete(old)
        return True

    def _read(self, held: dict, columns: list[str], terms: DataFrame | None = None) -> DataFrame:
        """segment and some columns of the blocks; of the given words (term) only, whose buckets alone are opened."""
        parts = []
        some = terms.select("term", bucket_of().alias("bucket")) if terms is not None else None
        buckets = sorted(r.bucket for r in some.select("bucket").distinct().collect()) if some is not None else None
        names = [r.term for r in some.select("term").limit(NAMED + 1).collect()] if some is not None else []
        for s in held["segments"]:
            part = self.spark.read.schema(_BLOCK).parquet(f"{self.path}/segments/{s}/blocks")
            if some is not None:
                part = part.where(F.col("bucket").isin(buckets))
                part = part.where(F.col("term").isin(names)) if len(names) <= NAMED else part.join(broadcast_if_small(some.select("term")), "term", "left_semi")
            parts.append(part.select(F.lit(s).alias("segment"), *columns))
        return reduce(DataFrame.unionByName, parts)

    def _left(self, held: dict, cuts: list[int]) -> DataFrame:
        """The postings that are left, in ranges of these cuts, a row for each bucket and range of some blocks."""

        def packed(batch: pa.RecordBatch, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.array(cuts, np.int64)
            for piece in pieces(batch, "positions", WORDS):
                part = _Range(pa.Table.from_batches([piece]), np.arange(piece.num_rows), gone, True)
                live = np.flatnonzero(part.live)
                if not len(live):
                    continue
                block, doc = np.repeat(part.term, part.n)[live], part.doc[live]
                bucket, ranges = piece.column("bucket").to_numpy(), np.searchsorted(edges, doc, side="right")
                order = np.lexsort((block, ranges, bucket[block]))
                live, block, doc, ranges = live[order], block[order], doc[order], ranges[order]
                tf = part.tf[live].astype(np.int64)
                places = part.places[_spread(part.place_ptr[live], tf)]
                yield _part(piece.column("term"), bucket, ranges, bucket[block].astype(np.int64) * (len(edges) + 1) + ranges, block, doc, part.len[live], tf, places)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from packed(batch, np.zeros(0, np.int64))

        def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, gone = None, []  # ids that are gone come before the blocks of their range
            for batch in batches:
                segment, number, share, kind = batch.column("segment").dictionary_encode().indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("range", "share", "kind"))
                cut = np.r_[_begins(segment, number, share, kind), batch.num_rows] if batch.num_rows else np.zeros(1, np.int64)
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    key = batch.column("segment")[s].as_py(), int(number[s]), int(share[s])
                    if key != now:
                        now, gone = key, []
                    if kind[s]:
                        yield from packed(batch.slice(s, e - s), np.concatenate([np.zeros(0, np.int64), *gone]))
                    else:
                        gone.append(batch.column("first").slice(s, e - s).to_numpy())

        blocks = self._read(held, ["bucket", "term", "range", "first", "n", "gaps", "tfs", "lens", "positions"])
        if not held["gone"]:
            return blocks.mapInArrow(whole, _PART)
        shares = F.explode(F.array(*(F.lit(k) for k in range(SHARES))))
        gone = self._gone(held).select("segment", "range", F.col("doc_id").alias("first"), F.lit(0).alias("kind"), shares.alias("share"))
        both = blocks.withColumn("kind", F.lit(1)).withColumn("share", F.pmod(F.xxhash64("term"), F.lit(SHARES)).cast("int")).unionByName(gone, allowMissingColumns=True)
        return both.repartition("segment", "range", "share").sortWithinPartitions("segment", "range", "share", "kind").mapInArrow(without, _PART)

    def _by_range(self, blocks: DataFrame, held: dict, words: list[str], run: Callable[[Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """run over (blocks of a range, numbers of their words, ids gone from it), a range after the other."""
        gone = self._gone(held).select("segment", "range", F.lit(0).alias("kind"), F.col("doc_id").alias("first"))
        both = blocks.withColumn("kind", F.lit(1)).unionByName(gone, allowMissingColumns=True) if held["gone"] else blocks.withColumn("kind", F.lit(1))
        dealt = both.repartition("segment", "range").sortWithinPartitions("segment", "range", "kind")
        shared = self.spark.sparkContext.broadcast(words)

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
            at = pa.array(shared.value, pa.string())
            now, parts = None, []

            def closed():
                table = pa.Table.from_batches(parts).combine_chunks()
                lost = int(np.searchsorted(table.column("kind").to_numpy(), 1))
                gone, kept = table.column("first").slice(0, lost).to_numpy(), table.slice(lost)
                if kept.num_rows:
                    yield kept, pc.index_in(kept.column("term").combine_chunks(), value_set=at).to_numpy().astype(np.int64), gone

            for whole in batches:
                segment, number = whole.column("segment").dictionary_encode().indices.to_numpy(), whole.column("range").to_numpy()
                cut = np.r_[_begins(segment, number), whole.num_rows]
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    key = whole.column("segment")[s].as_py(), int(number[s])
                    if key != now and parts:
                        yield from closed()
                        parts = []
                    now = key
                    parts.append(whole.slice(s, e - s))
            if parts:
                yield from closed()

        return dealt.mapInArrow(lambda batches: run(ranges(batches)), schema)

    def _frequencies(self, held: dict, terms: DataFrame, words: list[str]) -> np.ndarray:
        """In how many of the documents that are left each word is."""
        df, at = np.zeros(len(words)), {w: k for k, w in enumerate(words)}
        for r in self._read(held, ["term", "n"], terms).groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[at[r.term]] = r.n
        if held["gone"]:
            touched = self._read(held, ["term", "range", "first", "n", "gaps"], terms).join(self._gone(held).select("segment", "range").distinct(), ["segment", "range"], "left_semi")

            def run(ranges) -> Iterator[pa.RecordBatch]:
                for table, term, gone in ranges:
                    n, gaps = table.column("n").to_numpy().astype(np.int64), table.column("gaps").combine_chunks().flatten().to_numpy()
                    lost = np.bincount(np.repeat(term, n)[np.isin(_ids(table.column("first").to_numpy(), n, gaps), gone)], minlength=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(lost)), pa.array(lost[lost > 0])], names=["t", "n"])

            for r in self._by_range(touched, held, words, run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
                df[r.t] -= r.n
        return df

    def _search(self, queries: DataFrame, k: int, weight: Callable[[np.ndarray, int, float], Weigh]) -> DataFrame:
        _, held = self._state()
        pairs = query_terms(queries)
        if not held["segments"]:
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        if not small_enough(pairs, TERMS):
            parts = 2 * -(-pairs.count() // TERMS)
            if queries.select("item_id").distinct().limit(2).count() < 2:
                raise ValueError(f"one query has more than {TERMS} words")
            some = [self._search(queries.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p), k, weight) for p in range(parts)]
            return reduce(DataFrame.unionByName, some)
        asked = _query_index(pairs)
        terms = pairs.select("term").distinct()
        weigh = weight(self._frequencies(held, terms, asked.words), held["docs"], held["words"] / max(held["docs"], 1))
        shared, read, scored = self.spark.sparkContext.broadcast(asked), self.read, self.scored

        def run(ranges) -> Iterator[pa.RecordBatch]:
            q = shared.value
            order = np.argsort(q.of, kind="stable")
            of_term = np.repeat(np.arange(len(q.words)), np.diff(q.ptr))[order]
            cut = np.searchsorted(q.of[order], np.arange(len(q.ids) + 1))
            keep, least = Best(len(q.ids), k), np.full(len(q.ids), -np.inf)
            for table, term, gone in ranges:
                part = _Range(table, term, gone)
                bounds = part.bounds(weigh)
                begin, end = np.searchsorted(part.term, np.arange(len(q.words))), np.searchsorted(part.term, np.arange(len(q.words)), side="right")
                read.add(len(part.term))
                for i in range(len(q.ids)):
                    own = of_term[cut[i] : cut[i + 1]]
                    blocks = _spread(begin[own], end[own] - begin[own])
                    if len(blocks):
                        doc, score, n = best_of_range(part, blocks, bounds, weigh, k, least[i])
                        scored.add(n)
                        keep.add_pairs(np.full(len(doc), i), score, doc)
                        if len(score) >= k:
                            least[i] = max(least[i], np.partition(score, -k)[-k])
            yield keep.batch(q.ids)

        columns = ["term", "range", "first", "n", "gaps", "tfs", "lens", "best_tf", "best_len"]
        hits = self._by_range(self._read(held, columns, terms), held, asked.words, run, "query_id long, vec_id long, sim double")
        return ranked(hits.select("query_id", F.col("vec_id").alias("doc_id"), F.col("sim").alias("score")), k)

    def bm25(self, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, doc_id, score, rank by Okapi BM25; queries: item_id, text."""

        def weight(df: np.ndarray, n: int, mean: float) -> Weigh:
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            return lambda t, tf, size: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))

        return self._search(queries, k, weight)

    def tfidf(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The same by the sum of (1 + ln tf) * ln(n / df)."""

        def weight(df: np.ndarray, n: int, mean: float) -> Weigh:
            idf = np.log(n / np.maximum(df, 1))
            return lambda t, tf, size: (1 + np.log(tf)) * idf[t]

        return self._search(queries, k, weight)

    def phrases(self, phrases: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """phrase_id, doc_id, n: how often the words of each phrase follow one another, from the positions of its words."""
        _, held = self._state()
        listed = phrases.select(F.col(f"`{id_col}`").cast("long").alias("phrase_id"), tokenize(F.col(f"`{text_col}`")).alias("w")).where("phrase_id is not null and size(w) > 0")
        schema = "phrase_id long, doc_id long, n long"
        if not held["segments"]:
            return self.spark.createDataFrame([], schema)
        if not small_enough(listed, TERMS):
            raise ValueError(f"more than {TERMS} phrases, or longer ones than can be broadcast")
        asked = sorted({(tuple(r.w), r.phrase_id) for r in listed.collect()})
        terms = listed.select(F.explode("w").alias("term")).distinct()
        words = sorted({w for ws, _ in asked for w in ws})
        numbers = {w: k for k, w in enumerate(words)}
        shared, longest = self.spark.sparkContext.broadcast([([numbers[w] for w in ws], i) for ws, i in asked]), max((len(ws) for ws, _ in asked), default=1)

        def run(ranges) -> Iterator[pa.RecordBatch]:
            for table, term, gone in ranges:
                part = _Range(table, term, gone, positions=True)
                ids, own = np.unique(part.doc, return_inverse=True)
                wide = int(part.len.max()) + longest
                times = np.where(part.live, part.tf, 0).astype(np.int64)
                begin, end = (part.ptr[np.searchsorted(part.term, np.arange(len(words)), side=s)] for s in ("left", "right"))
                last, places = (None, None), {}

                def at(t: int) -> np.ndarray:
                    """document * wide + place of all occurrences of a word, rising."""
                    if t not in places:
                        rows = np.arange(begin[t], end[t])
                        rows = rows[times[rows] > 0]
                        places[t] = np.repeat(own[rows] * wide, part.tf[rows]) + part.places[_spread(part.place_ptr[rows], part.tf[rows].astype(np.int64))]
                    return places[t]

                out = []
                for ws, i in shared.value:
                    if last[0] != ws:
                        held_at = at(ws[0])
                        for k, t in enumerate(ws[1:], 1):
                            if not len(held_at):
                                break
                            held_at = held_at[np.isin(held_at + k, at(t), assume_unique=True)]
                        last = ws, np.unique(held_at // wide, return_counts=True)
                    doc, n = last[1]
                    out.append((np.full(len(doc), i), ids[doc], n))
                p, d, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))], names=["phrase_id", "doc_id", "n"])

        columns = ["term", "range", "first", "n", "gaps", "tfs", "lens", "positions"]
        return self._by_range(self._read(held, columns, terms), held, words, run, schema)
