"""Joins of intervals that overlap, by bins of doubling width.

An interval has the level at which a bin is about as wide as itself, so it meets two bins there at most, and
two at most at every wider level. Of two overlapping intervals the longer one's level is looked at: it files itself
there, the shorter one files itself at its own and all wider levels that occur. That is an equality join
on (keys, level, bin); long and short intervals meet without one being cut into the other's bins. A
pair counts in the bin that holds the start of what the two share, so it counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.sources.tables import fresh

MOST_LEVELS = 62


def level_of(start: Column, end: Column) -> Column:
    """The least l with 2**l at least as long as the interval."""
    return F.when(end - start <= 1, 0).otherwise(F.length(F.bin(end - start - 1))).cast("int")


def _bins(start: Column, end: Column, level: Column) -> Column:
    """The bins of width 2**level that [start, end) meets."""
    first, last = F.call_function("shiftright", start, level), F.call_function("shiftright", F.greatest(end - 1, start), level)
    return F.sequence(first, last)


def overlaps(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows with equal `on` whose intervals [start, end) share a point, as columns l and r (structs).

    start and end are whole numbers (such as microseconds) less than 2**62 in size; rows with a null among them or `on`,
    and empty intervals, have no partner.
    """
    known = [F.col(f"`{c}`") for c in [*on, start, end]]
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")

    def shaped(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(on)), s.alias(f"{side}s"), e.alias(f"{side}e"), F.struct(*(f"`{c}`" for c in df.columns)).alias(side), *([] if on else [F.lit(0).alias("__k0")]))
        ok = [F.col(f"{side}s").isNotNull(), F.col(f"{side}e").isNotNull(), F.col(f"{side}s") < F.col(f"{side}e")]
        for c in ok:
            rows = rows.where(c)
        return rows.withColumn(f"{side}n", level_of(F.col(f"{side}s"), F.col(f"{side}e")))

    keys = [f"__k{i}" for i in range(max(len(on), 1))]
    a, b = shaped(left, "l"), shaped(right, "r")

    def levels(df: DataFrame, side: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"{side}n").distinct().collect())

    def met(long_: DataFrame, ls: str, short: DataFrame, ss: str, strict: bool) -> DataFrame:
        """Pairs in which the first is at least as long by level (longer, if strict)."""
        there = F.array(*(F.lit(n) for n in levels(long_, ls))).cast("array<int>")
        own = long_.withColumn("__level", F.col(f"{ls}n")).withColumn("__bin", F.explode(_bins(F.col(f"{ls}s"), F.col(f"{ls}e"), F.col("__level"))))
        wider = F.filter(there, lambda n: n > F.col(f"{ss}n") if strict else n >= F.col(f"{ss}n"))
        other = short.withColumn("__level", F.explode(wider)).withColumn("__bin", F.explode(_bins(F.col(f"{ss}s"), F.col(f"{ss}e"), F.col("__level"))))
        pairs = own.join(other, [*keys, "__level", "__bin"]).where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
        return pairs.where(F.col("__bin") == F.call_function("shiftright", F.greatest("ls", "rs"), F.col("__level"))).select("l", "r")

    return met(a, "l", b, "r", False).unionByName(met(b, "r", a, "l", True))
