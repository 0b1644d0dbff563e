"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (two to four bytes of
the lower-cased text, everything but letters blanked), each hashed to one of
2**16 rows (Joulin et al. 2017). Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on a bounded, documented sample: `per_lang`
texts a language and `bound` in all, by hash of the id (a cut-off by each language's
count first, so no task ranks all rows of a language). For scoring the two
matrices are multiplied out, so a text costs one gather an n-gram.

A fifth of the sample is held back to calibrate: a temperature for the scores,
and the score under which a prediction is rejected, chosen so that accepted ones
are right in 99 % of the held-back texts. `rejected` carries that decision;
`lang_pred` is always the likeliest learned language, or `und` where the text is
null or has no letter.

Defined results: without learnable rows every text is `und` with score 0. Texts
shorter than two bytes use the prior alone. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import fresh, slices, text_buffer
from loamstone.llm.samples import first_rows, fold, share_for, under

BITS, ORDERS, WIDTH = 16, (2, 3, 4), 16
PER_LANG, BOUND = 500, 5_000
#: Counts of up to so many languages are broadcast.
MANY_LANGS = 10_000
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = 32
_BLANK[97:123] = np.arange(97, 123)
_BLANK[65:91] = np.arange(97, 123)
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte (the last n - 1 have none)."""
    wide = data.astype(np.uint32)
    h = np.full(max(len(data) - n + 1, 0), n * 0x01000193, np.uint32)
    for j in range(n):
        h = (h ^ wide[j : j + len(h)]) * _MULT[j]
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def _ranges(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    begin = offsets[:-1]
    return begin, np.maximum(offsets[1:] - n + 1, begin)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data = _BLANK[data]
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        count = np.zeros(len(offsets) - 1)
        for n in ORDERS:
            begin, end = _ranges(offsets, n)
            full = np.flatnonzero(end > begin)
            if not len(full):
                continue
            rows = np.vstack([self.table[ngrams(data, n)], np.zeros((1, len(self.langs)), self.table.dtype)])
            at = np.stack([begin[full], end[full]], axis=1).ravel()
            total[full] += np.add.reduceat(rows, at, axis=0)[::2]
            count += end - begin
        return total / np.maximum(count, 1)[:, None] + self.bias

    def proba(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], *, epochs: int = 10, rate: float = 0.2, seed: int = 7) -> Model:
    """bags: distinct buckets of each text and their shares."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = ((rng.random((1 << BITS, WIDTH), dtype=np.float32) - 0.5) / WIDTH).astype(np.float32)
    out = ((rng.random((WIDTH, len(langs)), dtype=np.float32) - 0.5) * 0.5).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 10 else np.zeros(len(bags), bool)
    learn = np.flatnonzero(~held)
    steps, at = epochs * max(len(learn), 1), 0
    for _ in range(epochs):
        for k in rng.permutation(learn).tolist():
            ids, share = bags[k]
            lr = rate * (1 - at / steps)
            at += 1
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # Shares are tiny; dividing by their square sum makes the text's own mean move by lr * back.
            emb[ids] -= (lr / max(float(share @ share), 1e-3)) * share[:, None] * back
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(float))
    some = np.flatnonzero(held)
    if len(some):
        z = np.array([bags[k][1] @ model.table[bags[k][0]] + model.bias for k in some.tolist()], float)
        best = (np.inf, 1.0)
        for t in np.geomspace(0.05, 50, 60):
            model.temperature = float(t)
            p = np.log(np.maximum(model.proba(z), 1e-12))
            # Targets keep one part in a hundred for the other languages, else no error would call for no doubt at all.
            best = min(best, (float(-(0.99 * p[np.arange(len(some)), y[some]] + 0.01 * p.mean(axis=1)).mean()), float(t)))
        model.temperature = best[1]
        p = model.proba(z)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[some]
        order = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
        model.reject_below = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, *, n: int = 4, out: int = 2, per_lang: int = PER_LANG, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = text_buffer(batch.column("text"))
                data = _BLANK[data]
                ids, counts = [], []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    i, c = np.unique(np.concatenate([ngrams(data[s:e], k) for k in ORDERS]), return_counts=True)
                    ids.append(i.astype(np.uint16).tobytes())
                    counts.append(c.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "lang", "ids", "counts"])

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).isNotNull().alias("ok")).where("ok and lang is not null and doc_id is not null").where(fold("doc_id", n) != out)
    h = F.xxhash64("doc_id")
    # Ids, not rows, are chosen; the estimate is lowered by more than its error, so that enough of them are under the cut-off.
    sizes = known.groupBy("lang").agg((F.approx_count_distinct("doc_id", 0.03) * 0.8).alias("size"))
    if sizes.limit(MANY_LANGS + 1).count() <= MANY_LANGS:
        sizes = F.broadcast(sizes)
    some = known.select("doc_id", "lang").join(sizes, "lang").where(under(h, share_for(per_lang, F.col("size")))).select("doc_id", "lang").distinct()
    ranked = some.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id")).alias("rn")).where(F.col("rn") <= per_lang)
    chosen = ranked.orderBy("rn", h, "doc_id").limit(bound).select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").join(F.broadcast(chosen), "doc_id")
    got = first_rows(texts, bound).mapInArrow(run, "doc_id long, lang string, ids binary, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return Model()
    bags = []
    for i, c in zip(got.column("ids").to_pylist(), got.column("counts").to_pylist(), strict=True):
        share = np.frombuffer(c, np.uint32).astype(np.float32)
        bags.append((np.frombuffer(i, np.uint16), share / max(share.sum(), 1)))
    # Held-back texts must not be picked by order of id alone: shuffle first.
    mixed = np.random.Generator(np.random.PCG64(3)).permutation(len(bags))
    y = np.array([langs.index(v) for v in got.column("lang").to_pylist()])
    return fit([bags[k] for k in mixed.tolist()], y[mixed], langs)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced)."""
    base = docs.drop("lang_pred", "score", "rejected")
    kept = base.columns
    mark = fresh("__letter", base)
    marked = base.withColumn(mark, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                letter = batch.column(mark).to_numpy(zero_copy_only=False)
                if model.langs:
                    p = model.proba(model.logits(*text_buffer(batch.column(text_col))))
                    top = np.where(letter, p.max(axis=1), 0.0)
                    lang = [model.langs[k] if ok else "und" for k, ok in zip(p.argmax(axis=1).tolist(), letter.tolist(), strict=True)]
                else:
                    top, lang = np.zeros(batch.num_rows), ["und"] * batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(top), pa.array(~letter | (top < model.reject_below))], names=[*kept, "lang_pred", "score", "rejected"])

    return marked.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
