"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units (a run of spaces and the run of other
characters after it; no piece of the vocabulary reaches over such a cut, which
is checked when the model is read). The units not seen before are joined into one
text whose suffixes are sorted, to the depth of the longest piece. Every piece
is binary-searched in the sorted suffixes: its range of them is where it occurs.
The occurrences are edges (place, length, piece), sorted by place into a table.

Relaxation depends on the model's kind. The public model here is a BPE model, whose
right result is that of its merge order rather than of a best path, so edges are
relaxed by merge rank: of the edges that join two neighbouring symbols of a unit
the best-ranked, leftmost one is taken, until none is left. All units go
through these rounds together in numpy; units of over 256 characters use a heap
over the same edges. Characters outside the vocabulary fall back to bytes.

Encoded units are remembered by a 64-bit hash, up to CACHE of them in a worker. Their
bytes are kept too and compared whenever one is met again; units that share a hash but
not their bytes are encoded on their own, so ids never depend on the hash.

Defined results: null and empty texts have no ids; decoding no ids, or null, gives
"". As in the public library a space and U+2581 are one character, so texts
with the latter decode to a space there; all others decode to themselves.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamstone.llm.common import slices, span_hashes, text_buffer, tidy

SPACE = "▁"
CHUNK, LONG, CACHE = 250_000, 256, 400_000


class Model:
    """A BPE SentencePiece model with byte fallback, read from its public file format."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.size = n
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        text = {i: p.id_to_piece(i) for i in normal}
        self.bytes_at = np.zeros(256, np.int32)
        for i in range(n):
            if p.is_byte(i):
                self.bytes_at[int(p.id_to_piece(i)[1:-1], 16)] = i
        if len({s for s in text.values()}) != len(text) or not any(p.is_byte(i) for i in range(n)):
            raise ValueError("a BPE model with byte fallback is needed")
        if p.encode("a a", out_type=str)[0][:1] != SPACE or p.decode(p.encode("  a  b\n\t ")) != "  a  b\n\t ":
            raise ValueError("the model must keep white space and put a space before the text")
        if any(SPACE in s.lstrip(SPACE) for s in text.values()):
            raise ValueError("a piece reaches over the start of a word")
        self.depth = max(map(len, text.values()))
        self.codes = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(sorted({c for s in text.values() for c in s}), 1):
            self.codes[ord(c)] = k
        #: Merge rank of each id, best first.
        self.rank = np.full(n, 1 << 30, np.int64)
        for k, i in enumerate(sorted(normal, key=lambda i: (-p.get_score(i), i))):
            self.rank[i] = k
        self.ids = np.array(normal, np.int32)
        self.lengths = np.array([len(text[i]) for i in normal])
        rows = np.zeros((len(normal), self.depth), np.uint16)
        for k, i in enumerate(normal):
            rows[k, : len(text[i])] = self.codes[[ord(c) for c in text[i]]]
        order = np.lexsort(rows.T[::-1])
        self.ids, self.lengths, rows = self.ids[order], self.lengths[order], rows[order]
        last = rows.copy()
        last[np.arange(self.depth)[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.low, self.high = self._keys(rows), self._keys(last)
        raw = [b"" for _ in range(n)]
        for i in normal:
            raw[i] = text[i].replace(SPACE, " ").encode()
        for b in range(256):
            raw[self.bytes_at[b]] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.text = np.zeros(0, np.uint8)
        self.text_at = np.zeros(0, np.int64)
        self.text_len = np.zeros(0, np.int64)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u2")).view(f"S{2 * self.depth}").ravel()

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Table (place, length) -> id of the piece that begins there and has that length, or -1."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint16)])
        suffixes = self._keys(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:n])
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        lo, hi = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        found = np.flatnonzero(hi > lo)
        many = (hi - lo)[found]
        where = order[np.repeat(lo[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        table = np.full((n, self.depth + 1), -1, np.int32)
        table[where, np.repeat(self.lengths[found], many)] = np.repeat(self.ids[found], many)
        return table

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit; spaces are U+2581 already."""
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        # The separator has code 0, as have characters outside the vocabulary; neither is in a piece.
        codes = self.codes[points]
        if units and "\0" in "".join(units):
            codes[points == 0] = 0
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size + 1) - (size + 1)
        table = self.edges(codes)
        unit = np.repeat(np.arange(len(units)), size)
        start = np.arange(len(unit)) + unit
        length = np.ones(len(start), np.int64)
        alive = size[unit] <= LONG
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for u in np.flatnonzero(size > LONG).tolist():
            s, n = self._by_heap(table, int(begin[u]), int(size[u]))
            done.append((np.full(len(s), u), s, n))
        unit, start, length = unit[alive], start[alive], length[alive]
        none = np.int64(1) << 62
        while len(unit):
            pair = np.full(len(unit), none)
            both = length[:-1] + length[1:]
            ok = np.flatnonzero((unit[:-1] == unit[1:]) & (both <= self.depth))
            ids = table[start[ok], both[ok]]
            hit = ids >= 0
            ok = ok[hit]
            pair[ok] = self.rank[ids[hit]] * len(unit) + ok
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(pair, first)
            stop = best == none
            if stop.any():
                over = np.repeat(stop, np.diff(np.r_[first, len(unit)]))
                done.append((unit[over], start[over], length[over]))
            else:
                over = np.zeros(len(unit), bool)
            p = (best[~stop] % len(unit)).astype(np.int64)
            length[p] += length[p + 1]
            keep = ~over
            keep[p + 1] = False
            unit, start, length = unit[keep], start[keep], length[keep]
        if not done:
            return [np.zeros(0, np.int32) for _ in units]
        unit, start, length = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((start, unit))
        unit, start, length = unit[order], start[order], length[order]
        ids = table[start, length]
        if (ids < 0).any():
            ids, unit = self._fallback(points, start, ids, unit)
        cut = np.searchsorted(unit, np.arange(len(units) + 1))
        return [ids[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _fallback(self, points: np.ndarray, start: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for symbols outside the vocabulary, which are single characters."""
        many = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids < 0)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in points[start[lost]].tolist()]
        many[lost] = [len(b) for b in spelled]
        out = np.repeat(ids, many)
        at = np.cumsum(many) - many
        for k, b in zip(lost.tolist(), spelled, strict=True):
            out[at[k] : at[k] + len(b)] = self.bytes_at[list(b)]
        return out, np.repeat(unit, many)

    def _by_heap(self, table: np.ndarray, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of a long unit's symbols."""
        rank, depth = self.rank, self.depth
        length, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and length[i] + length[j] <= depth:
                k = table[begin + i, length[i] + length[j]]
                if k >= 0:
                    heapq.heappush(heap, (int(rank[k]), i, length[i] + length[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, total = heapq.heappop(heap)
            j = after[i] if length[i] else n
            if j >= n or length[i] + length[j] != total:
                continue
            length[i], length[j] = total, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        size = np.array(length)
        some = np.flatnonzero(size)
        return some + begin, size[some]

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Encode new units, at most CHUNK characters at once, and remember them."""
        if len(self.hashes) + len(units) > CACHE and len(self.hashes):
            self.forget()
        got: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for u in units:
            part.append(u)
            size += len(u)
            if size >= CHUNK:
                got += self.encode_units(part)
                part, size = [], 0
        if part:
            got += self.encode_units(part)
        count = np.array([len(x) for x in got], np.int64)
        flat = np.concatenate([self.flat, *got]).astype(np.int32)
        at = np.cumsum(count) - count + len(self.flat)
        raw = [u.replace(SPACE, " ").encode("utf-8", "surrogatepass") for u in units]
        size = np.array([len(x) for x in raw], np.int64)
        begin = np.cumsum(size) - size + len(self.text)
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.flat = every[order], flat
        self.at, self.count = np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
        self.text_at, self.text_len = np.concatenate([self.text_at, begin])[order], np.concatenate([self.text_len, size])[order]

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes


@functools.cache
def load(path: str) -> Model:
    return Model(path)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before every text, unit starts and ends, the units' hashes, and rows' offsets into them."""
    texts = [(" " + t.replace(SPACE, " ")) if t else "" for t in column.to_pylist()]
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = True
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(data)] if len(starts) else starts
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> bool:
    """Whether every span of data, one after the other, equals the bytes of `other` given for it."""
    own = ends - starts
    if (own != size).any():
        return False
    shift = np.repeat(at - (np.cumsum(own) - own), own)
    mine = data if len(data) == len(shift) else data[np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(len(shift))]
    return bool((mine == other[shift + np.arange(len(shift))]).all())


def _by_text(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for each unit, told apart by their bytes alone; nothing is remembered."""
    raw = data.tobytes()
    every = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    number = {u: k for k, u in enumerate(dict.fromkeys(every))}
    got: list[np.ndarray] = []
    part: list[str] = []
    size = 0
    for u in number:
        part.append(u.decode("utf-8", "surrogatepass").replace(" ", SPACE))
        size += len(u)
        if size >= CHUNK:
            got += model.encode_units(part)
            part, size = [], 0
    got += model.encode_units(part) if part else []
    ids = [got[number[u]] for u in every]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)


def encode_batch(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows and the rows' offsets into them."""
    pieces = []
    whole = pa.RecordBatch.from_arrays([column], names=["text"])
    for batch in slices(whole):
        data, starts, ends, hashes, rows = _units(batch.column("text"))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same(data, starts, ends, data, starts[first][back], (ends - starts)[first][back]):
            flat, many = _by_text(model, data, starts, ends)
            pieces.append((flat, np.concatenate([[0], np.cumsum(many)])[rows]))
            continue
        new = np.flatnonzero(model.unknown(distinct))
        if len(new) + len(model.hashes) > CACHE:
            model.forget()
            new = np.arange(len(distinct))
        if len(new):
            # A unit starts at a space or the text's start and so at a character's first byte.
            raw = data.tobytes()
            model.learn(distinct[new], [raw[s:e].decode("utf-8", "surrogatepass").replace(" ", SPACE) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        k = np.searchsorted(model.hashes, distinct)
        if not _same(data, starts[first], ends[first], model.text, model.text_at[k], model.text_len[k]):
            flat, many = _by_text(model, data, starts, ends)
            pieces.append((flat, np.concatenate([[0], np.cumsum(many)])[rows]))
            continue
        k = k[back]
        many, at = model.count[k], model.at[k]
        total = np.cumsum(many)
        flat = model.flat[np.repeat(at - (total - many), many) + np.arange(total[-1] if len(total) else 0)]
        pieces.append((flat, np.concatenate([[0], total])[rows]))
    base = np.cumsum([0, *(len(f) for f, _ in pieces)])
    flat = np.concatenate([np.zeros(0, np.int32), *(f for f, _ in pieces)])
    ends = [np.zeros(1, np.int64), *(o[1:] + b for (_, o), b in zip(pieces, base.tolist(), strict=False))]
    return flat, np.concatenate(ends).astype(np.int64)


def decode_ids(model: Model, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    many = model.raw_len[flat]
    total = np.concatenate([[0], np.cumsum(many)])
    raw = model.raw[np.repeat(model.raw_at[flat] - total[:-1], many) + np.arange(total[-1])].tobytes()
    cut = total[offsets].tolist()
    out = []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        b = raw[s:e]
        out.append((b[1:] if b[:1] == b" " else b).decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", to: str = "ids", check: bool = False) -> DataFrame:
    """docs with an array of piece ids; with `check` also n_pieces and round_trip, whether they decode to the text.

    Columns of these names are replaced. Checking decodes in the same worker, so no second one is started.
    """
    more = [to, "n_pieces", "round_trip"] if check else [to]
    base = docs.drop(*more)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                flat, offsets = encode_batch(model, batch.column(text_col))
                made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                if check:
                    back = decode_ids(model, flat, offsets)
                    made += [pa.array(np.diff(offsets)), pa.array([a == (b or "") for a, b in zip(back, batch.column(text_col).to_pylist(), strict=True)])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *more])

    added = [T.StructField(to, T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return base.mapInArrow(tidy(run), T.StructType([*base.schema.fields, *added[: len(more)]]))


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """encoded with the text of its ids (a column of that name is replaced)."""
    base = encoded.drop(to)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(ids_col)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(decode_ids(model, flat, np.concatenate([[0], np.cumsum(size)])), pa.string())], names=[*kept, to])

    return base.mapInArrow(tidy(run), T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), decoded_sha256, same (the text came back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                flat, offsets = encode_batch(model, batch.column(text_col))
                texts = decode_ids(model, flat, offsets)
                cut = offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).cast(pa.int64()),
                        pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(flat[s:e].astype("<i4").tobytes()).hexdigest() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                        pa.array([a == (b or "") for a, b in zip(texts, batch.column(text_col).to_pylist(), strict=True)]),
                    ],
                    names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "same"],
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, same boolean")
