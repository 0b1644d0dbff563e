"""Bounded samples of labelled rows for the classifiers.

Samples are the rows of the smallest hashes. A cut-off taken from a count comes first,
so hardly more rows than the sample leave their tasks, however many partitions there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def share_for(bound: int, n: Column | int) -> Column | float:
    """The share of n rows that holds `bound` of them, but for a chance of one in a billion."""
    most = bound + 6 * math.sqrt(bound) + 20
    return min(1.0, most / max(n, 1)) if isinstance(n, int) else F.least(F.lit(1.0), F.lit(most) / n)


def under(hashed: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash lies in the lowest share of its range."""
    return hashed.cast("double") <= (share - 0.5) * 2.0**64 if isinstance(share, float) else hashed.cast("double") <= (share - F.lit(0.5)) * F.lit(2.0**64)


def first_by_hash(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """The `bound` rows of the smallest hashes of the id."""
    h = F.xxhash64(F.col(id_col))
    return rows.where(under(h, share_for(bound, rows.count()))).orderBy(h, F.col(id_col)).limit(bound)


def first_rows(rows: DataFrame, bound: int) -> DataFrame:
    """At most `bound` rows, those of the smallest hashes of id and text: ids that repeat can bring more rows than ids were chosen."""
    return rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, bound: int, n: int, out: int, id_col: str = "doc_id", text_col: str = "text", clean_bound: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows of the learning folds.

    Rows are chosen by a hash of the id, so the choice does not depend on file
    order; with clean_bound, `bound` holds for positive labels
    and clean_bound for the others. Repeated labels of an
    id count once, as their largest; null labels and ids don't count. The chosen
    ids are bounded so and are broadcast, so texts are not shuffled; the rows of ids that
    repeat are bounded after that.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label")).where(fold(id_col, n) != out)
    if clean_bound is None:
        chosen = first_by_hash(known, id_col, bound)
    else:
        chosen = first_by_hash(known.where("label > 0"), id_col, bound).union(first_by_hash(known.where("label <= 0"), id_col, clean_bound))
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "label")
    return first_rows(rows, bound + (clean_bound or 0))
