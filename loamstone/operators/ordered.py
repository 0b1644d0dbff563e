"""Ranks, exact percentiles and modes of groups of any size: no task and no buffer holds a group.

Ranks. Rows are cut into ranges of (group, order, hash of the row), whatever the number of groups, and numbered
within group and range. A summary of each range (its rows, distinct order values, first and last one and how
often these occur) tells by running sums what lies before it, also where rows of one order value fill
several ranges. So a group, or a value, with most of the rows is many tasks' work.

Percentiles. Sketched cut-offs divide each group's values into intervals, which are counted; the interval
that holds a wanted place is cut again, until few enough distinct values are left to be ranked by their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.sources.tables import broadcast_if_small, fresh, scratch

RANGE_ROWS, MOST_RANGES = 1_000_000, 10_000
#: Cut-offs of a group in one pass, and distinct values that are ranked at once.
CUTS, RANKED = 256, 1_000_000


def ranks(df: DataFrame, by: list[str], order: list[str], *, descending: bool = False, tiles: int = 4, ranges: int | None = None) -> DataFrame:
    """df with rn, rk, dr, tile, pr, cd: row_number, rank, dense_rank, ntile, percent_rank and cume_dist of each row in its group, by the columns `order`.

    Among rows of equal order rn goes by a hash of the whole row; rows equal in all columns are numbered in any order.
    Nulls come first, or last if descending. Columns named like results are replaced.
    """
    made = ("rn", "rk", "dr", "tile", "pr", "cd")
    df = df.drop(*(c for c in made if c not in [*by, *order]))
    ranges = ranges or min(max(-(-df.count() // RANGE_ROWS), 1), MOST_RANGES)
    at, h = fresh("__at", df), fresh("__hash", df)
    by, bare = [f"`{b}`" for b in by], [F.col(f"`{o}`") for o in order]
    order = [c.desc() if descending else c.asc() for c in bare]
    rows = df.withColumn(h, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))
    path = scratch(df.sparkSession, "ranges")
    # Written, as ranges are cut by a sample that another run might take differently.
    rows = rows.repartitionByRange(ranges, *(F.col(b) for b in by), *order, h).withColumn(at, F.spark_partition_id())
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)

    own = Window.partitionBy(*by, at)
    key, rn, rk, dr, upto = (fresh(c, rows) for c in ("__key", "__rn", "__rk", "__dr", "__upto"))
    placed = rows.withColumns({key: F.struct(*bare), rn: F.row_number().over(own.orderBy(*order, h)), rk: F.rank().over(own.orderBy(*order)), dr: F.dense_rank().over(own.orderBy(*order))})
    placed = placed.withColumn(upto, F.count(F.lit(1)).over(own.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = placed.groupBy(*by, at).agg(
        F.count(F.lit(1)).alias("n"), F.max(dr).alias("distinct"), F.min_by(key, rn).alias("low"), F.max_by(key, rn).alias("high"),
        F.max(F.when(F.col(rk) == 1, F.col(upto))).alias("n_low"), (F.count(F.lit(1)) - F.max(rk) + 1).alias("n_high"),
    )
    line = Window.partitionBy(*by).orderBy(at)
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumns({"rows": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*by)), "goes_on": F.coalesce(F.col("low").eqNullSafe(F.lag("high").over(line)) & F.lag("n").over(line).isNotNull(), F.lit(False)), "went_on": F.coalesce(F.col("high").eqNullSafe(F.lead("low").over(line)) & F.lead("n").over(line).isNotNull(), F.lit(False))})
    # Where the first value of a range began, and where its last one ends, may lie several ranges off.
    begins = F.when(~F.col("goes_on") | (F.col("distinct") > 1), F.col("rows") + F.col("n") - F.col("n_high") + 1)
    ends = F.when(~F.col("went_on") | (F.col("distinct") > 1), F.col("rows") + F.col("n_low"))
    parts = parts.withColumns({"first_rank": F.last(begins, ignorenulls=True).over(before), "last_end": F.first(ends, ignorenulls=True).over(after), "values": F.coalesce(F.sum("distinct").over(before), F.lit(0)) - F.sum(F.col("goes_on").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    held = fresh("__part", placed)
    names = [fresh(f"__by{k}", placed) for k in range(len(by))]
    where = fresh("__where", placed)
    small = broadcast_if_small(parts.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col(at).alias(where), F.struct("n", "rows", "total", "goes_on", "went_on", "first_rank", "last_end", "values").alias(held)))
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)], F.col(at) == F.col(where))
    p = F.col(held)
    rank = F.when(p["goes_on"] & (F.col(rk) == 1), p["first_rank"]).otherwise(p["rows"] + F.col(rk))
    end = F.when(p["went_on"] & (F.col(upto) == p["n"]), p["last_end"]).otherwise(p["rows"] + F.col(upto))
    number, n = p["rows"] + F.col(rn), p["total"]
    size, more = F.floor(n / tiles), n % tiles
    tile = F.when(number <= more * (size + 1), F.floor((number - 1) / (size + 1)) + 1).otherwise(more + F.floor((number - 1 - more * (size + 1)) / F.greatest(size, F.lit(1))) + 1)
    out = {"rn": number, "rk": rank, "dr": p["values"] + F.col(dr), "tile": tile.cast("long"), "pr": F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.0), "cd": end / n}
    return placed.join(small, match).select(*(f"`{c}`" for c in df.columns), *(v.alias(k) for k, v in out.items()))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and mode: the most frequent value of each group that isn't null, of equally frequent ones the least. Values are counted before groups meet."""
    counts = df.where(F.col(f"`{value}`").isNotNull()).groupBy(*by, F.col(f"`{value}`").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*by).agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and p0, p1 ..: each share's exact percentile (linear between neighbours, as SQL's percentile_cont) of the values of a group that aren't null, as doubles.

    Rounds go on while an interval that holds a wanted place has over RANKED distinct values, by estimate;
    each divides it at about CUTS sketched values, and a value that is a cut is an interval of its own, so
    frequent values are found by counting alone.
    """
    spark = df.sparkSession
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)), F.col(f"`{value}`").cast("double").alias("v")).where("v is not null")
    path = scratch(spark, "percentiles")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = F.array(*(F.lit(float(s)) * (F.col("n") - 1) for s in shares))
    places = n.select(*keys, F.posexplode(at).alias("share", "at")).select(*keys, "share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    # Places `under` lie below the open interval (lo, hi), which has no bound where that is null; val: the value, once it is known.
    places.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "under": F.lit(0).cast("long"), "val": F.lit(None).cast("double")}).write.parquet(f"{path}/0")
    step = 0
    while True:
        wanted = spark.read.parquet(f"{path}/{step}")
        open_ = wanted.where("val is null").select(*keys, "lo", "hi").distinct()
        inside = (F.col("o.lo").isNull() | (F.col("r.v") > F.col("o.lo"))) & (F.col("o.hi").isNull() | (F.col("r.v") < F.col("o.hi")))
        held = rows.alias("r").join(broadcast_if_small(open_).alias("o"), _same("r", "o", keys) & inside).select(*(f"r.{k}" for k in keys), "o.lo", "o.hi", "r.v")
        sketch = held.groupBy(*keys, "lo", "hi").agg(F.approx_count_distinct("v").alias("d"), F.array_distinct(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], CUTS * 8)).alias("cuts"))
        sketch.write.parquet(f"{path}/sketch{step}")
        large = spark.read.parquet(f"{path}/sketch{step}").where(F.col("d") > RANKED)
        if large.isEmpty():
            break
        spans = [*keys, "lo", "hi"]
        cut = held.alias("r").join(broadcast_if_small(large).alias("o"), _same("r", "o", spans)).select(*(f"r.{k}" for k in spans), "r.v", "o.cuts")
        # Odd: the value is a cut; even: it lies between two.
        part = F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        counted = cut.groupBy(*spans, part.alias("part")).agg(F.count(F.lit(1)).alias("c")).join(broadcast_if_small(large.select(*(F.col(k).alias(f"l_{k}") for k in spans), "cuts")), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in spans))).select(*spans, "part", "c", "cuts")
        upto = F.sum("c").over(Window.partitionBy(*spans).orderBy("part"))
        half, odd = F.floor(F.col("part") / 2).cast("int"), F.col("part") % 2 == 1
        counted = counted.select(*spans, "c", upto.alias("upto"), F.when(odd, F.get("cuts", half)).alias("val"), F.coalesce(F.get("cuts", half - 1), F.col("lo")).alias("from"), F.coalesce(F.get("cuts", half), F.col("hi")).alias("to"))
        place = F.col("r.place") - F.col("r.under")
        meet = _same("r", "o", spans) & F.col("r.val").isNull() & (place < F.col("o.upto")) & (place >= F.col("o.upto") - F.col("o.c"))
        both = wanted.alias("r").join(counted.alias("o"), meet, "left")
        hit = F.col("o.c").isNotNull()
        narrowed = both.select(*(f"r.{k}" for k in keys), "r.share", "r.at", "r.place", F.when(hit, F.col("o.from")).otherwise(F.col("r.lo")).alias("lo"), F.when(hit, F.col("o.to")).otherwise(F.col("r.hi")).alias("hi"), F.when(hit, F.col("r.under") + F.col("o.upto") - F.col("o.c")).otherwise(F.col("r.under")).alias("under"), F.coalesce("r.val", "o.val").alias("val"))
        narrowed.write.parquet(f"{path}/{step + 1}")
        step += 1
    spans = [*keys, "lo", "hi"]
    values = held.groupBy(*spans, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = values.withColumn("upto", F.sum("c").over(Window.partitionBy(*spans).orderBy("v")))
    place = F.col("r.place") - F.col("r.under")
    meet = _same("r", "o", spans) & (place < F.col("o.upto")) & (place >= F.col("o.upto") - F.col("o.c"))
    found = ranked.alias("o").join(broadcast_if_small(wanted.where("val is null")).alias("r"), meet).select(*(f"r.{k}" for k in keys), "r.share", "r.at", "r.place", "o.v")
    every = found.unionByName(wanted.where("val is not null").select(*keys, "share", "at", "place", F.col("val").alias("v")))
    low, high = F.min_by("v", "place"), F.max_by("v", "place")
    one = every.groupBy(*keys, "share").agg((low + (high - low) * (F.min("at") - F.min("place"))).alias("p"))
    wide = one.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == i, F.col("p"))).alias(f"p{i}") for i in range(len(shares))))
    return wide.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), *(f"p{i}" for i in range(len(shares))))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))
