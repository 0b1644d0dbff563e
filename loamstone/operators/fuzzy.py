"""Words within an edit distance of others, by deletion neighbourhoods (Mor & Fraenkel 1982); built-in functions only.

Two words at most d edits apart share what is left of their first PREFIX characters after at most d
deletions each: s substitutions, i insertions and e deletions leave PREFIX - s - max(i, e) of
those characters in common and in order. So an equality join on such remainders finds all pairs, and the
exact distance is taken of these alone. A word has 37 remainders at d = 2, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import tokenize

PREFIX = 8


def terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term: the distinct words of all texts."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col(f"`{text_col}`")))).alias("term")).distinct()


def remainders(term: Column, distance: int) -> Column:
    """What is left of the first PREFIX characters after 0 to `distance` deletions, each once."""
    every = level = F.array(F.substring(term, 1, PREFIX))
    for _ in range(distance):
        without = F.transform(level, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(PREFIX)))))
        level = F.array_distinct(F.flatten(without))
        every = F.array_union(every, level)
    return every


def near_terms(asked: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """asked, term, distance: all pairs of words (column term of both, distinct, not null) at most so many edits apart."""
    if not 0 <= distance < PREFIX:
        raise ValueError(f"a distance from 0 to {PREFIX - 1}")
    left = asked.select(F.col("term").alias("asked"), F.length("term").alias("n"), F.explode(remainders(F.col("term"), distance)).alias("rest"))
    right = dictionary.select("term", F.length("term").alias("m"), F.explode(remainders(F.col("term"), distance)).alias("rest"))
    pairs = left.join(right, "rest").where(F.abs(F.col("n") - F.col("m")) <= distance)
    near = pairs.withColumn("distance", F.levenshtein("asked", "term", distance)).where(F.col("distance").between(0, distance))
    # A pair meets once for each remainder in common; only near pairs are left to be made one.
    return near.groupBy("asked", "term").agg(F.first("distance").alias("distance"))


def starting_with(dictionary: DataFrame, prefixes: DataFrame, shortest: int = 1) -> DataFrame:
    """prefix, term: all words that begin with each of many prefixes (column term), joined on their first `shortest` characters or more.

    Prefixes of a length meet the words' beginnings of that length, so the join is one equality a distinct length, in one pass.
    """
    sized = prefixes.select(F.col("term").alias("prefix"), F.length("term").alias("n")).where(F.col("n") >= shortest).distinct()
    lengths = sorted(r.n for r in sized.select("n").distinct().collect())
    if not lengths:
        return dictionary.select(F.lit(None).cast("string").alias("prefix"), "term").limit(0)
    begins = F.array_compact(F.array(*(F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths)))
    return dictionary.select("term", F.explode(begins).alias("prefix")).join(sized.select("prefix"), "prefix").select("prefix", "term")
