"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are words of letters, digits and non-ASCII characters (A-Z lowered). The
chain has two tags, clean and toxic. Labels come by document, so learning has
three steps, all on a bounded, documented sample of the learning folds (`bound`
toxic and twice as many clean texts, by hash of the id):

 1. Cues. For every word and every word beginning of 4, 5 and 6 bytes, Spark counts
    the sample's toxic and clean texts that hold it (one text of each group of
    near copies). Those far more frequent in toxic texts become cues, in rounds that
    leave out what earlier cues explain; a token of a toxic text that bears a cue is
    labelled toxic. Cues are as many as the sample shows, which bounds them.
 2. The field. Windows around cues, and all windows without any, train emission weights
    of the cues and the tag transitions by gradient ascent on the exact
    likelihood, with forward-backward expectations.
 3. Calibration. Document features from the marginals (their maximum, and the
    expected number of toxic tokens) go through a logistic curve weighted to the
    true share of toxic texts.

Scoring reads whole texts. Between tokens that bear cues the chain is constant, so
forward and backward messages cross a gap of any length in closed form (powers of
the 2 x 2 transition matrix); marginals are exact and long texts cost no more
than their cues. Tokens with a marginal of at least `span_at` are offending spans.

Defined results: null and empty texts have no tokens and get the score of a text
without cues. Without toxic labels all scores are the smoothed share of toxic
texts (0.5 / (n + 1) without any). Repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import ALNUM, lowered, mix, ngram_hashes, slices, span_hashes, text_buffer, word_spans
from loamstone.llm.samples import fold, labelled

BOUND = 2_500
PREFIXES = (4, 5, 6)
WINDOW = 8
#: Toxic texts with so many cues teach no further ones.
EXPLAINED = 3
#: A cue is in at least this share of toxic texts among those that hold it, and so many nats from chance.
MIN_SHARE, MIN_EVIDENCE = 0.6, 10.0


def token_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's word and beginnings; a beginning as long as the word is none (0)."""
    out = [span_hashes(low, starts, ends)]
    for n in PREFIXES:
        h = mix(span_hashes(low, starts, np.minimum(starts + n, ends)) + np.uint64(n))
        out.append(np.where(ends - starts > n, h, np.uint64(0)))
    return out


@dataclass
class Field:
    cues: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    #: Log potentials of clean->toxic, toxic->clean, toxic->toxic; clean->clean is 0.
    trans: tuple[float, float, float] = (0.0, 0.0, 0.0)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def prepare(self) -> None:
        """The matrix of a step to a token without cues, split by its eigenvalues."""
        ct, tc, tt = self.trans
        a, b, c, d = 1.0, math.exp(ct + self.bias), math.exp(tc), math.exp(tt + self.bias)
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        hi, lo = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = lo / hi
        self.p1 = tuple(x / (hi - lo) for x in (a - lo, b, c, d - lo))
        self.p2 = tuple(x / (hi - lo) for x in (hi - a, -b, -c, hi - d))
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.cues & np.uint64(0xFFFF)).astype(int)] = True

    def gap(self, k: int) -> tuple[float, float, float, float]:
        """The k-th power of that matrix, up to a positive factor."""
        if k == 0:
            return 1.0, 0.0, 0.0, 1.0
        r = self.ratio**k
        return tuple(x + r * y for x, y in zip(self.p1, self.p2, strict=True))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is a cue, and the cue's number."""
        if not len(self.cues):
            return np.zeros(0, int), np.zeros(0, int)
        some = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFF)).astype(np.int32)])
        at = np.minimum(np.searchsorted(self.cues, hashes[some]), len(self.cues) - 1)
        hit = self.cues[at] == hashes[some]
        return some[hit], at[hit]

    def marginals(self, at: list[int], emission: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens `at` with their cues' weights, in a text of n tokens."""
        ct, tc, tt = self.trans
        ect, etc, ett = math.exp(ct), math.exp(tc), math.exp(tt)
        ahead, last = [], -1
        c, t = 1.0, 0.0  # before the first token: as after a clean one
        for i, w in zip(at, emission, strict=True):
            g = self.gap(i - last - 1)
            c, t = c * g[0] + t * g[2], c * g[1] + t * g[3]
            e = math.exp(min(self.bias + w, 60.0))
            c, t = c + t * etc, (c * ect + t * ett) * e
            s = c + t
            c, t = c / s, t / s
            ahead.append((c, t))
            last = i
        out, c, t, nxt = [0.0] * len(at), 1.0, 1.0, n
        for k in range(len(at) - 1, -1, -1):
            g = self.gap(nxt - at[k] - 1)
            c, t = g[0] * c + g[1] * t, g[2] * c + g[3] * t
            x, y = ahead[k][0] * c, ahead[k][1] * t
            out[k] = y / (x + y)
            e = math.exp(min(self.bias + emission[k], 60.0))
            c, t = c + ect * e * t, etc * c + ett * e * t
            s = c + t
            c, t, nxt = c / s, t / s, at[k]
        return out

    def document(self, m: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * m + c * math.log1p(total)))))


def _cue_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = text_buffer(batch.column("text"))
                low = lowered(data)
                starts, ends, rows = word_spans(low, offsets, ALNUM)
                feats = token_features(low, starts, ends)
                label = batch.column("label").to_numpy() > 0
                own = [np.unique(np.concatenate([f[s:e] for f in feats])) for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                if not own:
                    continue
                h, inv = np.unique(np.concatenate(own), return_inverse=True)
                who = np.repeat(label, [len(x) for x in own])
                n, t = np.bincount(inv, minlength=len(h)), np.bincount(inv, who, len(h))
                keep = h != 0
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64)), pa.array(t[keep].astype(np.int64))], names=["h", "n", "t"])

    return sample.mapInArrow(run, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _cues(sample: DataFrame) -> np.ndarray:
    """Sorted cues of a sample (doc_id, label, text), in rounds.

    Each round takes the features far more frequent in toxic texts than chance allows,
    by Chernoff's bound: their number times the divergence of their toxic share from the
    sample's. Toxic texts that hold EXPLAINED cues are then left out of the next round,
    in which the share of toxic texts is lower and rarer cues, as those of a language
    with few toxic texts, stand out. Rounds end when one finds nothing new.
    """
    cues = np.zeros(0, np.uint64)
    while True:
        known = Field(cues=cues, weights=np.zeros(len(cues)))
        known.prepare()
        some = _without(sample, known, EXPLAINED) if len(cues) else sample
        totals = some.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("t")).first()
        if not totals.t or totals.t == totals.n:
            return cues
        rate = totals.t / totals.n
        share = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-12))
        evidence = F.col("n") * (share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate)))
        found = _cue_counts(some).where((F.col("t") > 0) & (share >= MIN_SHARE) & (share > rate) & (evidence >= MIN_EVIDENCE)).select("h").toArrow()
        more = np.union1d(cues, found.column("h").to_numpy().view(np.uint64))
        if len(more) == len(cues):
            return cues
        cues = more


def _without(sample: DataFrame, known: "Field", n: int) -> DataFrame:
    """The sample less its toxic texts that hold n of the known cues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                held = np.array([len(set().union(*cues)) for _, _, _, _, cues, _, _ in _places(batch, known)], int)
                yield batch.filter(pa.array((batch.column("label").to_numpy() <= 0) | (held < n)))

    return sample.mapInArrow(run, sample.schema)


def _near_key(sample: DataFrame) -> DataFrame:
    """The sample's texts with the least hash of their word triples, which near copies mostly share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = text_buffer(batch.column("text"))
                low = lowered(data)
                starts, ends, rows = word_spans(low, offsets, ALNUM)
                words = span_hashes(low, starts, ends)
                grams = ngram_hashes(words, 3)
                keys = [int((grams[s : e - 2] if e - s > 2 else words[s:e]).min(initial=np.uint64(2**64 - 1)).view(np.int64)) if e > s else 0 for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), batch.column("label"), pa.array(keys, pa.int64())], names=["doc_id", "text", "label", "near"])

    return sample.mapInArrow(run, "doc_id long, text string, label int, near long")


def _places(batch: pa.RecordBatch, model: Field) -> Iterator[tuple[int, int, list[int], list[float], list[list[int]], np.ndarray, np.ndarray]]:
    """For each row: its number, tokens, tokens with cues, their summed weights and cues, and byte spans of all tokens."""
    data, offsets = text_buffer(batch.column("text"))
    low = lowered(data)
    starts, ends, rows = word_spans(low, offsets, ALNUM)
    hits, cues = [], []
    for f in token_features(low, starts, ends) if len(starts) else []:
        at, which = model.lookup(f)
        hits.append(at)
        cues.append(which)
    at, which = (np.concatenate(x) if x else np.zeros(0, int) for x in (hits, cues))
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    cut = np.searchsorted(at, rows)
    for r in range(len(rows) - 1):
        places: dict[int, list[int]] = {}
        for i, k in zip(at[cut[r] : cut[r + 1]].tolist(), which[cut[r] : cut[r + 1]].tolist(), strict=True):
            places.setdefault(i - int(rows[r]), []).append(k)
        own = list(places)
        yield r, int(rows[r + 1] - rows[r]), own, [float(model.weights[places[i]].sum()) for i in own], [places[i] for i in own], starts[rows[r] : rows[r + 1]] - offsets[r], ends[rows[r] : rows[r + 1]] - offsets[r]


def _fit_chain(windows: list[tuple[dict[int, list[int]], bool, int]], n_cues: int, *, steps: int = 150, rate: float = 0.2, l2: float = 0.2) -> tuple[np.ndarray, float, tuple[float, float, float]]:
    """Emission weights, bias and transitions that maximise the windows' likelihood. A window: cues by place, whether its text is toxic, and how many such windows there are."""
    size = 2 * WINDOW + 1
    row, col, cue = [], [], []
    tags = np.zeros((len(windows), size))
    many = np.array([n for _, _, n in windows], float)
    for k, (places, toxic, _) in enumerate(windows):
        for i, some in places.items():
            tags[k, i] = toxic
            for c in some:
                row.append(k)
                col.append(i)
                cue.append(c)
    row, col, cue = (np.array(x, int) for x in (row, col, cue))
    theta = np.zeros(n_cues + 4)
    theta[n_cues] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros_like(theta)
    np.add.at(gold, cue, tags[row, col] * many[row])
    gold[n_cues] = many @ tags.sum(axis=1)
    before = np.concatenate([np.zeros((len(tags), 1)), tags[:, :-1]], axis=1)
    gold[n_cues + 1 :] = [many @ x.sum(axis=1) for x in ((1 - before) * tags, before * (1 - tags), before * tags)]
    for step in range(1, steps + 1):
        w, bias, (ct, tc, tt) = theta[:n_cues], theta[n_cues], np.exp(np.clip(theta[n_cues + 1 :], -20, 20))
        emit = np.full(tags.shape, bias)
        np.add.at(emit, (row, col), w[cue])
        e = np.exp(np.clip(emit, -30, 30))
        c, t = np.ones(len(tags)), np.zeros(len(tags))
        fc, ft = [], []
        for i in range(size):
            c, t = c + t * tc, (c * ct + t * tt) * e[:, i]
            s = c + t
            c, t = c / s, t / s
            fc.append(c)
            ft.append(t)
        bc, bt = np.ones(len(tags)), np.ones(len(tags))
        want = np.zeros_like(theta)
        marg = np.zeros_like(tags)
        for i in range(size - 1, -1, -1):
            z = fc[i] * bc + ft[i] * bt
            marg[:, i] = ft[i] * bt / z
            pc, pt = (fc[i - 1], ft[i - 1]) if i else (np.ones(len(tags)), np.zeros(len(tags)))
            x = np.stack([pc * bc, pc * ct * e[:, i] * bt, pt * tc * bc, pt * tt * e[:, i] * bt])
            x /= x.sum(axis=0)
            want[n_cues + 1 :] += x[1:] @ many
            bc, bt = bc + ct * e[:, i] * bt, tc * bc + tt * e[:, i] * bt
            s = bc + bt
            bc, bt = bc / s, bt / s
        np.add.at(want, cue, marg[row, col] * many[row])
        want[n_cues] = many @ marg.sum(axis=1)
        grad = (gold - want - l2 * theta * (np.arange(len(theta)) != n_cues)) / max(many.sum(), 1)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return theta[:n_cues], float(theta[n_cues]), tuple(np.clip(theta[n_cues + 1 :], -20, 20).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    pen = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (weight * (y - p)) - pen @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + pen + 1e-6 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = BOUND, n: int = 4, out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Field:
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y")).where(fold(id_col, n) != out)
    shares = {bool(r.t): r.n for r in known.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    pos, neg = shares.get(True, 0), shares.get(False, 0)
    model = Field()
    prior = (pos + 0.5) / (pos + neg + 1) if pos else 0.5 / (neg + 1)
    model.curve = (math.log(prior / (1 - prior)), 0.0, 0.0)
    model.prepare()
    if not pos or not neg:
        return model
    sample = _near_key(labelled(docs, labels, label, bound=bound, n=n, out=out, id_col=id_col, text_col=text_col, clean_bound=2 * bound))
    first = sample.groupBy("near").agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.*").persist()
    try:
        model.cues = _cues(first)
        model.weights = np.zeros(len(model.cues))
        model.prepare()

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    got = [(batch.column("doc_id")[r].as_py(), batch.column("label")[r].as_py(), n, at, cues) for r, n, at, _, cues, _, _ in _places(batch, model)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.int32()), pa.array([x[3] for x in got], pa.list_(pa.int32())), pa.array([x[4] for x in got], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "label", "n", "at", "cues"])

        texts = first.mapInArrow(gather, "doc_id long, label int, n int, at array<int>, cues array<array<int>>").toArrow().sort_by("doc_id").to_pylist()
    finally:
        first.unpersist()
    windows: list[tuple[dict[int, list[int]], bool, int]] = []
    clean = 0
    for d in texts:
        place, free = dict(zip(d["at"], d["cues"], strict=True)), d["n"]
        i = 0
        while i < len(d["at"]):
            mid = d["at"][i]
            windows.append(({p - mid + WINDOW: c for p, c in place.items() if abs(p - mid) <= WINDOW}, d["label"] > 0, 1))
            while i < len(d["at"]) and d["at"][i] <= mid + WINDOW:
                i += 1
            free -= 2 * WINDOW + 1
        clean += max(free, 0) // (2 * WINDOW + 1)
    # Windows without cues are all alike.
    windows += [({}, False, clean)] if clean else []
    model.weights, model.bias, model.trans = _fit_chain(windows, len(model.cues))
    model.prepare()
    x, y = [], []
    for d in texts:
        m = model.marginals(d["at"], [float(model.weights[c].sum()) for c in d["cues"]], d["n"])
        x.append((max(m, default=0.0), math.log1p(sum(m))))
        y.append(d["label"] > 0)
    y = np.array(y, float)
    weight = np.where(y > 0, pos / (pos + neg) / max(y.sum(), 1), neg / (pos + neg) / max((1 - y).sum(), 1)) * len(y)
    model.curve = tuple(_logistic(np.array(x), y, weight).tolist())
    return model


SPANS = "array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, model: Field, *, span_at: float = 0.5, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score, predicted and toxic_spans (code points, end exclusive); columns of these names are replaced."""
    base = docs.drop("score", "predicted", "toxic_spans")
    kept = base.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                scores, spans = [], []
                data, offsets = text_buffer(batch.column(text_col))
                view = pa.RecordBatch.from_arrays([batch.column(text_col)], names=["text"])
                for r, n, at, weight, _, starts, ends in _places(view, model):
                    m = model.marginals(at, weight, n)
                    scores.append(model.document(max(m, default=0.0), sum(m)))
                    bad = [(i, p) for i, p in zip(at, m, strict=True) if p >= span_at]
                    own = []
                    if bad:
                        points = np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
                        own = [{"start": int(points[starts[i]]) - 1, "end": int(points[ends[i] - 1]), "p": p} for i, p in bad]
                    spans.append(own)
                s = np.array(scores, float)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, kind)], names=[*kept, "score", "predicted", "toxic_spans"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))
