"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does, over symbols: each phrase is the longest one already
in the text's dictionary plus the next symbol, and enters the dictionary. Symbols are
words, cut into pieces of at most 16 bytes, so texts without spaces parse as well. Texts that compress alike share phrases, so the likeness of two texts is
the Jaccard likeness of their phrase sets, estimated from minimum-hash signatures
of 128 values of 16 bits, printed as hexadecimal text.

Defined results: null and wordless texts have no phrases and the fingerprint "";
two such are alike (1), one such and another text are not (0). Equal texts have
equal fingerprints. Order is by descending id, null ids last; rows that share an id, or
have none, follow one another by a hash of their text, then by text. An id that holds a
large part of the rows, null too, is dealt out by that hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import NONSPACE, slices, span_hashes, text_buffer, word_spans

VALUES = 128
PIECE = 16
_MASK = (1 << 64) - 1
_MULT = 0xD6E8FEB86659FD93
_rng = np.random.Generator(np.random.PCG64(78))
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def phrases(words: list[int]) -> set[int]:
    """Hashes of the LZ78 phrases of a run of words; a phrase's hash extends that of its prefix."""
    known: set[int] = set()
    node = 0
    for w in words:
        node = (node * _MULT + w) & _MASK
        if node not in known:
            known.add(node)
            node = 0
    return known


def _pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of at most PIECE bytes from those of words."""
    n = -(-(ends - starts) // PIECE)
    if (n == 1).all():
        return starts, ends
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(starts, n) + PIECE * nth
    return begin, np.minimum(begin + PIECE, np.repeat(ends, n))


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint16 (rows, VALUES) and which rows have phrases."""
    data, offsets = text_buffer(column)
    starts, ends = _pieces(*word_spans(data, offsets, NONSPACE)[:2])
    rows = np.searchsorted(starts, offsets)
    words = span_hashes(data, starts, ends).tolist()
    sets = [phrases(words[s:e]) for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    size = np.array([len(s) for s in sets], int)
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = np.flatnonzero(size)
    if len(full):
        every = np.fromiter((h for s in sets for h in s), np.uint64, int(size.sum()))
        every ^= every >> np.uint64(29)
        at = (np.cumsum(size) - size)[full]
        for k in range(VALUES):
            v = ((every ^ _B[k]) * _A[k] >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(v, at) & 0xFFFF
    return out, size > 0


def _print(sig: np.ndarray, full: bool) -> str:
    return sig.astype(">u2").tobytes().hex() if full else ""


def likeness(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Share of equal signature values; fa and fb: whether the sides have phrases."""
    return np.where(fa & fb, (a == b).mean(axis=1), (fa == fb).astype(float))


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the column fingerprint (replaced if there is one)."""
    base = docs.drop("fingerprint")
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                sig, full = signatures(batch.column(text_col))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([_print(s, f) for s, f in zip(sig, full, strict=True)], pa.string())], names=[*kept, "fingerprint"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("fingerprint", T.StringType())]))


def _neighbours(docs: DataFrame, per_partition: int) -> DataFrame:
    """(r, ghost, doc_id, h, text): rows dealt into ranges r of descending ids; each range ends with a ghost, the next range's first row.

    Range bounds come from quantiles of the ids. An id with the rows of several ranges
    gets ranges of its own, by h, a hash of the text. Heads are a minimum by range.
    Bounds, such ids and heads are as many as there are ranges, whatever the input's size.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * per_partition
    docs = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n))
    # Only what spans two bounds can hold the rows of several ranges; as must most rows, if there are no bounds.
    hot = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin([int(c) for c in cuts])).groupBy("doc_id").agg(F.count("*").alias("m")).collect()
    size = max(docs.count() // n, 1)
    many = {r.doc_id: min(-(-r.m // size), n) for r in hot if r.m >= 2 * size and (r.doc_id is None or abs(r.doc_id) < 1 << 52)}
    cuts = sorted(cuts | {float(i + k) for i in many if i is not None for k in (0, 1)}) or [0.0]
    bucket = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
    place = F.when(F.col("at").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("bucket")).cast("long")
    within = F.lit(0)
    for i, k in many.items():
        within = F.when(F.col("doc_id").eqNullSafe(F.lit(i).cast("long")), F.least(F.floor((F.col("h").cast("double") * 2.0**-64 + 0.5) * k), F.lit(k - 1))).otherwise(within)
    dealt = bucket.transform(docs.withColumn("at", F.col("doc_id").cast("double"))).withColumn("r", place * n + within).select("r", "doc_id", "h", "text")
    first = F.struct((-F.col("doc_id")).alias("a"), F.col("h"))
    heads = sorted((x.r, x.head.a, x.head.h) for x in dealt.groupBy("r").agg(F.min(first).alias("head")).collect())
    if not heads:
        return dealt.select("r", F.lit(0).alias("ghost"), "doc_id", "h", "text")
    before = [(heads[k - 1][0], r, None if a is None else -a, h) for k, (r, a, h) in enumerate(heads)]
    firsts = F.broadcast(spark.createDataFrame(before, "to long, r long, head long, first_h long"))
    ghosts = dealt.join(firsts, "r").where("doc_id <=> head and h = first_h").groupBy("to").agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("first"))
    rows = dealt.select("r", F.lit(0).alias("ghost"), "doc_id", "h", "text").union(ghosts.select(F.col("to").alias("r"), F.lit(1).alias("ghost"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), "first.text"))
    # Ranges are about equally large, so they are dealt in turn, not by a hash.
    turn = F.pmod(F.floor(F.col("r") / n) + F.col("r") % n, F.lit(parts)).cast("int")
    return rows.repartitionById(parts, turn).sortWithinPartitions("r", "ghost", F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first())


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges_per_partition: int = 4) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document, by descending id.

    The edited text has its last third of code points replaced by as many (or
    all) of the next document's first; the last document's next is the first.
    """
    rows = _neighbours(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ranges_per_partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: (r, ghost, id, text, signature, whether it has phrases)
        for whole in batches:
            for batch in slices(whole):
                sig, full = signatures(batch.column("text"))
                now = list(zip(batch.column("r").to_pylist(), batch.column("ghost").to_pylist(), batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), sig, full, strict=True))
                seen = ([held] if held else []) + now
                pairs = [(a, b) for a, b in zip(seen[:-1], seen[1:], strict=True) if a[0] == b[0] and not a[1]]
                held = now[-1]
                if not pairs:
                    continue
                texts = []
                for a, b in pairs:
                    third = len(a[3]) // 3
                    texts.append(a[3][: len(a[3]) - third] + b[3][:third])
                esig, efull = signatures(pa.array(texts, pa.large_string()))
                own, ofull = np.stack([a[4] for a, _ in pairs]), np.array([a[5] for a, _ in pairs])
                nsig, nfull = np.stack([b[4] for _, b in pairs]), np.array([b[5] for _, b in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                        pa.array([_print(s, f) for s, f in zip(own, ofull, strict=True)], pa.string()),
                        pa.array([_print(s, f) for s, f in zip(esig, efull, strict=True)], pa.string()),
                        pa.array(likeness(own, esig, ofull, efull)),
                        pa.array(likeness(own, nsig, ofull, nfull)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
