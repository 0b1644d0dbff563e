"""Whitening of embeddings by upper-triangle column aggregates.

Every step over the rows is a generated Spark SQL expression; only sums come to the driver.

 1. A vector's entries become whole numbers, x = floor(SCALE * c) + SHIFT, one column a
    dimension. One aggregation counts the rows and sums each dimension.
 2. Columns are centred, and one aggregation sums the product of every pair of dimensions
    on and above the diagonal. It has a row for each vector and dimension i and sums, for each i, its products
    with i, i + 1 .. around to i + dims / 2, which is every pair once; a column a pair would be 2,080
    sums in one row, more than Spark compiles well (measured: 1.3 ms a vector, against 0.1). Tasks
    pass on one row a dimension.
 3. The driver mirrors the sums into a matrix of dimensions x dimensions, whatever
    the number of rows, and LAPACK's symmetric solver (numpy's eigh) decomposes it.
 4. Each row's whitened components are sums of its centred columns with the axes as
    literals, divided by the root of the variance.

Centring comes before multiplying: x less the whole part of the mean is exact, and only
the mean's remainder is a fraction, so a shift of any size costs no digits.

Defined results: rows whose vector is null, holds a null or an entry that is not finite
(or whose x would need more than 52 bits) are left out, as are rows of another length than the
most frequent one (of equally frequent ones the greater). Repeated rows and ids count as
often as they occur; a null id stays null. Without rows, or with empty vectors only, the
result has no rows. A component along which the rows don't vary has a null `whitened`, as
it can't be scaled to 1, and is no part of the identity error. Of two equal
variances the solver's order decides. `deviation` is null where it needs over 38 digits.
Columns named like a result are replaced; others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import fresh, stored

SCALE, SHIFT = 1024, 100_000
#: Sums a dimension in one aggregation (the pairs of up to 511 dimensions).
AT_ONCE = 256
_LARGEST = 2.0**52


@dataclass
class Whitener:
    """n rows with sums by dimension; variances falling, and their unit axes as columns; total is the trace."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    total: float
    #: The largest sum over dimensions of (n * x - sum)**2 that a row of the fit list could have.
    most: int = 0

    @property
    def varies(self) -> list[bool]:
        """Whether the rows vary along each component, by the usual tolerance of a rank."""
        least = len(self.sums) * np.finfo(float).eps * max(self.total, 0.0)
        return [bool(v > least) for v in self.variances]

    def explained(self, k: int) -> float:
        return float(self.variances[k] / self.total) if self.total > 0 else 0.0


def whole(vectors: DataFrame, vector_col: str, to: str) -> tuple[DataFrame, int]:
    """The complete vectors, whose whole numbers are in the array column `to`, and their length."""
    c = F.col(f"`{vector_col}`")
    fits = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < _LARGEST))
    kept = vectors.where(fits)
    common = kept.groupBy(F.size(c).alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    dims = common.dims if common else 0
    # The condition holds in rows that are kept; it is said again as Spark may work this out before it drops the others.
    number = F.transform(c, lambda v: F.when(F.abs(v.cast("double") * SCALE) < _LARGEST, F.floor(v.cast("double") * SCALE) + SHIFT))
    return kept.where(F.size(c) == dims).withColumn(to, number), dims


def _summed(rows: DataFrame, columns: list[str]) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and each column's sum, least and greatest value; sums that 64 bits can't hold are summed as decimals."""
    got = rows.selectExpr("count(*) AS n", *(f"array(try_sum({c}), min({c}), max({c})) AS v" for c in columns)).first()
    sums, low, high = (list(v) for v in zip(*got[1:], strict=True)) if columns else ([], [], [])
    if got[0] and None in sums:
        sums = [int(v) for v in rows.selectExpr(*(f"sum(CAST({c} AS DECIMAL(38, 0))) AS v" for c in columns)).first()]
    return got[0], sums, low, high


def products(centred: DataFrame, column: str, dims: int) -> np.ndarray:
    """Sums of the products of every pair of entries of an array column, as a symmetric matrix."""
    out = np.zeros((dims, dims))
    each = centred.select(F.col(column).alias("d"), F.posexplode(column).alias("i", "v"))
    steps = range(dims // 2 + 1)
    for s in range(0, len(steps), AT_ONCE):
        some = steps[s : s + AT_ONCE]
        sums = each.groupBy("i").agg(F.expr("array(" + ", ".join(f"sum(v * d[(i + {k}) % {dims}])" for k in some) + ")").alias("sums"))
        for r in sums.collect():
            for k, v in zip(some, r.sums, strict=True):
                j = (r.i + k) % dims
                out[r.i, j] = out[j, r.i] = v
    return out


def _centred(x: str, n: int, sums: list[int]) -> list[str]:
    """Expressions of the entries of x less their mean, as doubles: the mean's whole part is taken off in whole numbers."""
    return [f"CAST(get(`{x}`, {k}) - {s // n}L AS DOUBLE) - {(s % n) / n!r}D" for k, s in enumerate(sums)]


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> Whitener:
    """The axes of the most variance of all complete vectors."""
    x = fresh("__x", vectors)
    rows, dims = whole(vectors, vector_col, x)
    columns = [f"`{x}`[{k}]" for k in range(dims)]
    n, sums, low, high = _summed(rows, columns)
    if not n or not dims:
        return Whitener(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    centred = rows.selectExpr(f"array({', '.join(_centred(x, n, sums))}) AS d")
    covariance = products(centred, "d", dims) / n
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True))
    return Whitener(n, [int(s) for s in sums], e, axes * np.where(lead < 0, -1.0, 1.0), float(np.trace(covariance)), most)


def _deviation(x: str, model: Whitener) -> Column:
    """Sum over dimensions of (n * x - sum)**2: in 64 bits where no row of the fit list needs more, else as decimals."""
    if model.most < 1 << 63:
        return F.expr(" + ".join(f"(`{x}`[{k}] * {model.n}L - {s}L) * (`{x}`[{k}] * {model.n}L - {s}L)" for k, s in enumerate(model.sums))).cast("decimal(38,0)")
    term = "CAST(CAST(`{x}`[{k}] AS DECIMAL(19, 0)) * CAST({n} AS DECIMAL(19, 0)) - CAST({s} AS DECIMAL(38, 0)) AS DECIMAL(38, 0))"
    total = "CAST(0 AS DECIMAL(38, 0))"
    for k, s in enumerate(model.sums):
        one = term.format(x=x, k=k, n=model.n, s=s)
        total = f"try_add({total}, CAST(try_multiply({one}, {one}) AS DECIMAL(38, 0)))"
    return F.expr(total).cast("decimal(38,0)")


def transform(vectors: DataFrame, model: Whitener, *, vector_col: str = "embedding") -> DataFrame:
    """The complete vectors' rows with `whitened` (an array, a component each) and `deviation`."""
    base = vectors.drop(*(c for c in ("whitened", "deviation") if c != vector_col))
    x = fresh("__x", base)
    rows, dims = whole(base, vector_col, x)
    if not model.n or not dims or dims != len(model.sums):
        return base.withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")}).limit(0)
    names = [fresh(f"__d{k}", rows) for k in range(dims)]
    centred = rows.select("*", *(F.expr(e).alias(name) for e, name in zip(_centred(x, model.n, model.sums), names, strict=True)))
    parts = []
    for k, varies in enumerate(model.varies):
        scale = float(np.sqrt(model.variances[k])) if varies else 1.0
        along = " + ".join(f"{name} * ({float(w)!r}D)" for name, w in zip(names, model.axes[:, k], strict=True))
        parts.append(f"({along}) / {scale!r}D" if varies else "CAST(NULL AS DOUBLE)")
    made = centred.withColumns({"whitened": F.expr(f"array({', '.join(parts)})"), "deviation": _deviation(x, model)})
    return made.select(*(f"`{c}`" for c in base.columns if c != "whitened"), "whitened", "deviation")


def identity_error(whitened: DataFrame, model: Whitener, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of whitened vectors less the identity, over components along which rows vary."""
    names = [f"`{column}`[{k}]" for k, varies in enumerate(model.varies) if varies]
    if not model.n or not names:
        return 0.0
    means = whitened.selectExpr(*(f"sum({c}) / {model.n} AS v" for c in names)).first()
    centred = whitened.selectExpr("array(" + ", ".join(f"{c} - ({m!r}D)" for c, m in zip(names, means, strict=True)) + ") AS d")
    return float(np.abs(products(centred, "d", len(names)) / model.n - np.eye(len(names))).max())


def whiten(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> tuple[DataFrame, Whitener, float]:
    """Fit and transform: the rows (written to the shared folder), the model, and the identity error of what was written."""
    model = fit(vectors, vector_col=vector_col, components=components)
    rows = stored(transform(vectors, model, vector_col=vector_col), "whitened")
    return rows, model, identity_error(rows, model)


def long_form(rows: DataFrame, model: Whitener, error: float, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    share = F.array(*(F.lit(model.explained(k)) for k in range(len(model.variances)))) if len(model.variances) else F.array().cast("array<double>")
    each = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
