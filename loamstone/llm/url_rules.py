"""URL filters as a sort-merge range join; built-in functions only.

A rule (host, path, verdict) fits its host and all subdomains, where the url's path starts
with the rule's. Of the rules that fit, the one of the longest text (host, then path) wins.

 * Keys. A host is written backwards, label by label, each label ended by "/" (no host holds
   one): org/example/. Its subdomains are then exactly what begins so. Keys are
   bytes, so a prefix p is the interval from p to p followed by FF, which no UTF-8 text holds,
   and the intervals of any set of rules lie inside or beside each other.
 * Sweep. Keys of points and both ends of each interval are sorted together. The running
   sum of +1 at a start and -1 at an end is the number of rules open there; the last start
   of each depth up to that number is the stack of rules open, outermost first.
 * The sweep runs in ranges of keys, dealt by cut-off keys of a bounded sample of the points
   (SAMPLE a range), about RANGE_ROWS points each. A rule goes to every range that its interval meets,
   which at a cut-off are only the rules open there.
 * Hosts are swept first: each distinct host gets the rules' hosts open there. Each
   distinct url whose host has any meets, for each, the rules' paths in a second sweep of the
   same kind, over (host, path), where the top of the stack is the longest path that fits. The
   longest rule of a url then goes to all rows that hold it, by a join which Spark can
   split at a url with many rows.

Defined results: a null url, or one without "://", has an empty host and path. Of rules of
the same host and path one counts, and blocks if any of them does; rules with a null
host, path or verdict don't count. Urls without a rule get a null rule and the default verdict.
Without rules, that is every url. Repeated rows and ids each keep their own row. The columns host,
path, rule and verdict are replaced; others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import fresh, stored

RANGE_ROWS, SAMPLE, MOST_RANGES = 200_000, 32, 1024
#: Bytes of a cut-off key; longer keys with a common beginning share a range.
CUT_BYTES = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Neither byte is part of any UTF-8 text: ends the host in keys of host and path; ends an interval.
_MIDDLE, _END = bytes([0xFE]), bytes([0xFF])


def host_path(url: Column | str) -> tuple[Column, Column]:
    """Host (after the first "://", A-Z lowered) and path of a url; both empty where there is none."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(F.instr(c, "://") > 0, F.substring(c, F.instr(c, "://") + 3, F.length(c))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(c)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """org/example/ of example.org, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/")).cast("binary")


def url_key(host: Column, path: Column) -> Column:
    return F.concat(host_key(host), F.lit(_MIDDLE), path.cast("binary"))


def salted(key: Column, by: Column) -> Column:
    """key followed by a hash, so that equal keys can lie in several ranges; it begins with the same texts as key does."""
    return F.concat(key, F.lit(_MIDDLE), F.hex(F.xxhash64(by)).cast("binary"))


def _cut_offs(points: DataFrame, key: str, n: int) -> list[list[bytes]]:
    """Keys that cut n points into ranges of about RANGE_ROWS, in groups of which each but the first begins with a coarse cut-off."""
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return [[]]
    most, h = ranges * SAMPLE, F.xxhash64(key)
    share = min(1.0, (most + 6 * math.sqrt(most) + 20) / n)
    some = points.select(F.substring(F.col(key), 1, CUT_BYTES).alias("k"), h.alias("h")).where(F.col("h").cast("double") <= (share - 0.5) * 2.0**64).orderBy("h", "k").limit(most)
    keys = sorted(bytes(r.k) for r in some.select("k").collect())
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    step = max(math.isqrt(len(cuts)), 1)
    return [cuts[s : s + step] for s in range(0, len(cuts), step)] or [[]]


def _range_of(key: Column, groups: list[list[bytes]]) -> Column:
    """How many cut-offs are at most the key: those of the groups before its own, and those of its own."""
    if not groups[0]:
        return F.lit(0)
    heads = F.lit([g[0] for g in groups])
    before = F.lit([0] + [sum(len(g) for g in groups[: k + 1]) for k in range(len(groups))])
    group = F.size(F.filter(heads, lambda c: c <= key))
    own = F.get(F.array(*(F.lit(g) for g in groups)), group - 1)
    at = F.get(before, group - 1) + F.size(F.filter(own, lambda c: c <= key))
    return F.when(group > 0, at).otherwise(0)


def _events(rules: DataFrame, groups: list[list[bytes]]) -> DataFrame:
    """(range, key, kind, step, value): the starts of each rule's interval in every range it meets, its end in the last."""
    end = F.concat(F.col("key"), F.lit(_END))
    spans = rules.select("key", "value", end.alias("end"), _range_of(F.col("key"), groups).alias("first"), _range_of(end, groups).alias("last"))
    starts = spans.select(F.explode(F.sequence("first", "last")).alias("range"), "key", F.lit(0).alias("kind"), F.lit(1).alias("step"), "value")
    ends = spans.select(F.col("last").alias("range"), F.col("end").alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(rules.schema["value"].dataType).alias("value"))
    return starts.unionByName(ends)


def sweep(points: DataFrame, rules: DataFrame, key: str, to: str) -> DataFrame:
    """points with the column `to`: values of the rules open at their key, outermost first. rules: key (bytes, distinct), value."""
    valued = rules.schema["value"].dataType
    groups = _cut_offs(points, key, points.count())
    events = _events(rules, groups)
    mark, kind, step, value, depth, level, at = (fresh(c, points) for c in ("__mark", "__kind", "__step", "__value", "__depth", "__level", "__range"))
    order = Window.partitionBy("range").orderBy("key", "kind")
    deepest = events.select(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("d")).agg(F.max("d")).first()[0] or 0
    if not deepest:
        return points.withColumn(to, F.array().cast(T.ArrayType(valued)))
    ours = events.select(F.col("range").alias(at), F.col("key").alias(mark), F.col("kind").alias(kind), F.col("step").alias(step), F.col("value").alias(value))
    theirs = points.withColumns({at: _range_of(F.col(key), groups), mark: F.col(key), kind: F.lit(1), step: F.lit(0), value: F.lit(None).cast(valued)})
    w = Window.partitionBy(at).orderBy(mark, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = theirs.unionByName(ours, allowMissingColumns=True).withColumn(depth, F.sum(step).over(w).cast("int"))
    # The value of the last start of each depth; those deeper than the present depth are closed.
    opened = [F.last(F.when((F.col(kind) == 0) & (F.col(depth) == d), F.col(value)), ignorenulls=True).over(w).alias(f"{level}{d}") for d in range(1, deepest + 1)]
    held = both.select("*", *opened).where(F.col(kind) == 1)
    return held.withColumn(to, F.slice(F.array(*(f"{level}{d}" for d in range(1, deepest + 1))), F.lit(1), F.col(depth))).select(*(f"`{c}`" for c in points.columns), to)


def tidy_rules(rules: DataFrame) -> DataFrame:
    """host (A-Z lowered), path, verdict: one row a host and path."""
    known = rules.where("host is not null and path is not null and verdict is not null and not rlike(host, '[/?#]')").select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    return known.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks")).select("host", "path", F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) in urls that some rule fits: the longest one's."""
    rules = stored(tidy_rules(rules), "url-rules")
    hosts = urls.select("host").distinct().withColumn("key", host_key(F.col("host")))
    named = rules.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("value"))
    open_hosts = stored(sweep(hosts, named, "key", "open").select("host", F.explode("open").alias("rule_host")), "url-hosts")
    probes = urls.join(open_hosts, "host").select("host", "path", salted(url_key(F.col("rule_host"), F.col("path")), F.col("host")).alias("key"))
    text, size = F.concat("host", "path"), F.length("host")
    paths = rules.select(url_key(F.col("host"), F.col("path")).alias("key"), F.struct((size + F.length("path")).alias("size"), size.alias("host_size"), text.alias("rule"), "verdict").alias("value"))
    found = sweep(stored(probes, "url-probes"), paths, "key", "open").where(F.size("open") > 0).select("host", "path", F.get("open", F.size("open") - 1).alias("best"))
    top = found.groupBy("host", "path").agg(F.max("best").alias("best"))
    return top.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the text of the longest rule that fits, or null) and verdict (allow or block: its own, else the default)."""
    named = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url_col))
    host, path = host_path(F.col(f"`{url_col}`"))
    h, p = fresh("__host", named), fresh("__path", named)
    made = named.withColumns({h: host, p: path})
    best = match(stored(made.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct(), "urls"), rules)
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.struct("rule", "verdict").alias(fresh("__best", named)))
    joined = made.join(best, [h, p], "left")
    got = F.col(best.columns[-1])
    return joined.select(*(f"`{c}`" for c in named.columns if c not in ("host", "path", "rule", "verdict")), F.col(h).alias("host"), F.col(p).alias("path"), got["rule"].alias("rule"), F.coalesce(got["verdict"], F.lit(default)).alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    """The five rules of the query, as a table."""
    return spark.sql("SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS rules(host, path, verdict)")
