"""Whitening against numpy on whole numbers; odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from loamstone.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, whitened string, __x string, __d0 string"


def frame(spark, vectors, ids=None):
    rows = [(ids[k] if ids else k, None if v is None else [None if c is None else float(c) for c in v], f"w{k}", f"x{k}", f"d{k}") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, components=8):
    """Whole numbers, their sums, and whitened components, by numpy."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum(int(n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    return n, deviation, c @ axes / np.sqrt(e), e / (c**2).sum() * n


@pytest.mark.parametrize("shift", [0.0, 4000.0])
def test_equals_numpy(spark, shift):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((300, 12)) * np.arange(1, 13) * 0.05 + shift).astype(np.float32)
    n, deviation, white, share = plain(v)
    rows, model, error = W.whiten(frame(spark, v.tolist()).repartition(5))
    got = {(r.vec_id, r.component): r for r in W.long_form(rows, model, error).collect()}
    assert len(got) == 300 * 8 and error < 1e-9
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i in range(300)])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-8
        assert abs(got[0, k + 1].explained / share[k] - 1) < 1e-9
    assert [got[i, 1].deviation for i in range(300)] == deviation and {r.n for r in got.values()} == {n}
    assert {r.whitened is not None for r in rows.collect()} == {True} and {r["__x"] for r in rows.collect()} == {f"x{k}" for k in range(300)}


def test_odd_rows(spark):
    """Null, short, null-holding and infinite vectors are left out; repeated rows and ids count."""
    good = [[1.0, 2.0], [2.0, 1.0], [3.0, 5.0], [3.0, 5.0]]
    odd = [None, [1.0, None], [math.nan, 1.0], [math.inf, 0.0], [-math.inf, 0.0], [1.0], [], [1e30, 0.0]]
    rows, model, error = W.whiten(frame(spark, good + odd, [1, None, 3, 3, *range(10, 18)]))
    got = W.long_form(rows, model, error).collect()
    n, deviation, white, _ = plain(good)
    assert model.n == n == 4 and error < 1e-9
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i in (1, None, 3, 3) for c in (1, 2))
    assert sorted({r.deviation for r in got}) == sorted(set(deviation))
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(np.abs(white).ravel()))


def test_without_rows_or_variance(spark):
    for none in ([], [None, []]):
        rows, model, error = W.whiten(frame(spark, none))
        assert W.long_form(rows, model, error).count() == 0 and error == 0
    rows, model, error = W.whiten(frame(spark, [[1.0, 2.0]] * 3))
    assert [(r.whitened, r.deviation, r.explained) for r in W.long_form(rows, model, error).collect()] == [(None, 0, 0.0)] * 6
    rows, model, error = W.whiten(frame(spark, [[1.0, 2.0], [2.0, 2.0]]))
    got = W.long_form(rows, model, error).collect()
    assert [abs(r.whitened) for r in got if r.component == 1] == [1.0, 1.0] and {r.whitened for r in got if r.component == 2} == {None}


def test_deviations_beyond_64_bits(spark):
    v = [[2.0**40, 1.0], [-(2.0**40), 3.0], [7.0, 5.0]]
    rows, model, _ = W.whiten(frame(spark, v))
    assert model.most >= 1 << 63
    x = [[math.floor(1024 * Fraction(c)) + 100_000 for c in r] for r in v]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {int(r.deviation) for r in rows.collect()} == {sum((3 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x}
    assert {r.deviation for r in W.long_form(rows, model, 0.0).collect()} == {None} | {d for d in (int(r.deviation) for r in rows.collect()) if d < 1 << 63}


def test_sums_in_several_aggregations(spark, monkeypatch):
    v = np.random.default_rng(2).standard_normal((50, 6)).astype(np.float32).tolist()
    one = W.fit(frame(spark, v))
    monkeypatch.setattr(W, "AT_ONCE", 2)
    assert np.allclose(W.fit(frame(spark, v)).variances, one.variances)
