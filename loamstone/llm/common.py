"""Shared plumbing: the cluster's shared folder, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space of the word contracts: space and \t \n \v \f \r.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
NONSPACE = np.ones(256, bool)
NONSPACE[list(WHITE)] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SLICE_BYTES = 1 << 20
#: Spans of more bytes are hashed one by one: a polynomial modulo 2**64 maps some long texts of two letters to one value.
STRONG_FROM = 64
#: Folders made by `shared_dir` in this process.
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests) is a
    temporary folder of this machine used instead.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = "file://" + tempfile.mkdtemp(prefix="loamstone-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete the folders of a `stored` table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        found = next((m for m in _made if path.split(":", 1)[-1].lstrip("/") == m.split(":", 1)[-1].lstrip("/")), None)
        if found:
            _delete(table.sparkSession, found)
            _made.remove(found)


def release(spark: SparkSession) -> int:
    """Delete every folder that operators have left in the shared folder; call it once their results are written. Returns how many."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands freed memory back to the system; workers live on and else keep their peak."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        for k, base in enumerate((_R, _RINV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (len + 1) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Cut a batch into row ranges of about `most` text bytes, so that work arrays stay small."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the offsets of each row's words."""
    inside = kind[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Short spans take prefix sums of a polynomial over random byte codes, all at once;
    those of over STRONG_FROM bytes a cryptographic hash, as such a polynomial has
    collisions there whatever its base. Equal spans have equal hashes wherever they lie.
    """
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[63])
    for k in np.flatnonzero(ends - starts > STRONG_FROM).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def row_words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows (A-Z lowered), and each row's offsets into them."""
    data, offsets = text_buffer(column)
    data = lowered(data)
    starts, ends, rows = word_spans(data, offsets, kind)
    return span_hashes(data, starts, ends), rows


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for each i; the caller drops those that cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += words[j : j + len(out)] * _STEP[j]
    return mix(out + np.uint64(n))
