"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, stored


def components(edges: DataFrame, a: str, b: str, name: str = "components", most: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star contraction (Kiveris et al. 2014):
    every node links its neighbours to their minimum until only stars are left.
    Each half is a partial aggregate and a join. Minima are dealt anew between the two,
    so that both sides of the join are plain shuffles and Spark can split the side of a
    node with a great many neighbours. Every round is
    written to the shared folder, the one before deleted. Rounds grow with the logarithm of the longest
    path; `most` only guards against a defect and raises.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    held = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())

    was = signature(held)
    for _ in range(most):
        if not was[0]:
            break
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, held = held, stored(small, name)
        discard(before)
        now = signature(held)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
