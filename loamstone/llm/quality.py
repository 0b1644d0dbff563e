"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees (two levels) are boosted feature by feature, in a cycle (Lou et
al. 2012, 2013); since each tree sees one binned feature, or one pair, the sum of
its trees is a lookup table. Scoring adds table entries by bin, vectorised.

The model is fitted on the driver from a bounded, documented sample of labelled
rows (`bound`, by hash of the id); every row is scored from its whole text only.

Defined results: null and empty texts have the features of an empty text and get
its score. Without labels every score is 0.5 (predicted 1); with one class the
smoothed rate of that class. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamstone.llm.common import NONSPACE, lowered, ngram_hashes, slices, span_hashes, text_buffer, tidy, word_spans
from loamstone.llm.samples import labelled

BOUND = 20_000
FEATURES = ["log_words", "word_length", "distinct_words", "top_word", "upper", "symbols", "exclaim", "bars", "digits", "stops", "same_as_last", "distinct_trigrams", "distinct_lines", "symbol_ended", "non_ascii", "log_chars"]

_UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    data, offsets = text_buffer(column)
    low = lowered(data)
    starts, ends, rows = word_spans(low, offsets, NONSPACE)
    words = span_hashes(low, starts, ends)
    n, size = np.diff(rows).astype(float), np.diff(offsets).astype(float)

    def per_row(mask: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.zeros(len(mask) + 1)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    letters = per_row(_LETTER[data])
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[rows[:-1][rows[:-1] < len(words)]] = False
    grams = ngram_hashes(words, 3)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lrows = word_spans(data, offsets, line)
    lines = span_hashes(data, ls, le)
    distinct, top, tri, dl = (np.ones(len(n)) for _ in range(4))
    for k, (s, e, a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), lrows[:-1].tolist(), lrows[1:].tolist(), strict=True)):
        if e > s:
            own = np.sort(words[s:e])
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            distinct[k], top[k] = (len(edge) - 1) / (e - s), np.diff(edge).max() / (e - s)
            if e - s > 2:
                own = np.sort(grams[s : e - 2])
                tri[k] = (1 + np.count_nonzero(own[1:] != own[:-1])) / len(own)
            if b - a > 1:
                dl[k] = len(set(lines[a:b].tolist())) / (b - a)
    out = [np.log1p(n), ratio(per_row(NONSPACE[data]), n), distinct, top, ratio(per_row(_UPPER[data]), letters), ratio(per_row(_SYMBOL[data]), size), ratio(per_row(data == 33), n), ratio(per_row(data == 124), n), ratio(per_row(_DIGIT[data]), size), ratio(per_row(data == 46), n), ratio(per_row(same, rows), n), tri, dl, ratio(per_row(_SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool), rows), n), ratio(per_row(data >= 128), size), np.log1p(size)]
    return np.stack(out, axis=1)


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (i, j), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cuts(v: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], method="midpoint"))


def _leaf(g: float, h: float, ridge: float) -> float:
    return -g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf value of every bin under a tree of two levels."""
    out = np.empty(len(g))
    _, cut = _stump(g, h, ridge)
    for s, e in ((0, cut), (cut, len(g))):
        if s < e:
            _, inner = _stump(g[s:e], h[s:e], ridge)
            for a, b in ((s, s + inner), (s + inner, e)):
                if a < b:
                    out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best pair of cuts of a two-way table: gain and leaf values (a tree of two levels over a pair)."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1)) if min(g.shape) > 1 else np.zeros((0, 0))
    if not gain.size:
        return 0.0, np.zeros_like(g)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, top, left, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, top - a, left - a, whole - top - left + a]

    for pg, ph in zip(parts(cg), parts(ch), strict=True):
        gain += pg**2 / (ph + ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for rs in (slice(0, i + 1), slice(i + 1, None)):
        for cs in (slice(0, j + 1), slice(j + 1, None)):
            out[rs, cs] = _leaf(g[rs, cs].sum(), h[rs, cs].sum(), ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, bins: int = 32, ridge: float = 5.0) -> Gam:
    n1 = float(y.sum())
    model = Gam(base=float(np.log((n1 + 1) / (len(y) - n1 + 1))))
    if not len(y) or n1 in (0, len(y)):
        return model
    model.edges = [_cuts(x[:, k], bins) for k in range(x.shape[1])]
    model.coarse = [_cuts(x[:, k], 8) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    f = np.full(len(y), model.base)
    prob = lambda: 1 / (1 + np.exp(-f))
    for _ in range(rounds):
        for k, b in enumerate(fine):
            p = prob()
            size = len(model.tables[k])
            t = rate * _tree(np.bincount(b, p - y, size), np.bincount(b, p * (1 - p), size), ridge)
            model.tables[k] += t
            f += t[b]
    flat = {}
    p = prob()
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
            b = rough[i] * shape[1] + rough[j]
            g, h = (np.bincount(b, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))
            gains.append((_quadrants(g, h, ridge)[0], i, j))
            flat[i, j] = b, shape
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs[i, j] = np.zeros(flat[i, j][1])
    for _ in range(pair_rounds):
        for key, t in model.pairs.items():
            b, shape = flat[key]
            p = prob()
            g, h = (np.bincount(b, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))
            step = rate * _quadrants(g, h, ridge)[1]
            t += step
            f += step.ravel()[b]
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = BOUND, n: int = 3, out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = labelled(docs, labels, label, bound=bound, n=n, out=out, id_col=id_col, text_col=text_col).mapInArrow(tidy(run), "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return fit(x, (np.array(got.column("label").to_pylist(), float) > 0).astype(float))


def score(docs: DataFrame, model: Gam, *, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score and a prediction under `names` (columns of these names are replaced)."""
    base = docs.drop(*names)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                s = model.score(features(batch.column(text_col)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, *names])

    return base.mapInArrow(tidy(run), T.StructType([*base.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))
