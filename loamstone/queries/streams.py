"""Streams: events are replayed from files until drained, then what was emitted is read back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.sources.tables import SCHEMAS, load, row_bytes, scratch
from loamstone.sources.upsert import UpsertTable
from loamstone.streaming import events as E
from loamstone.streaming import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _arriving(spark: SparkSession, parts: list[DataFrame], files: int, name: str) -> str:
    """A folder with `files` files a part at most, whose modification times rise from part to part."""
    path = scratch(spark, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen: set[str] = set()
    for k, part in enumerate(parts):
        part.repartition(files).write.mode("append").parquet(path)
        for s in fs.listStatus(at):
            if s.getPath().getName().startswith("part-") and s.getPath().getName() not in seen:
                seen.add(s.getPath().getName())
                fs.setTimes(s.getPath(), 1_000_000_000_000 + 60_000 * k, -1)
    return path


def _files(df: DataFrame, bytes_a_file: int = 64 << 20) -> int:
    """How many files a part of a stream takes: four, more as its bytes ask for."""
    return max(4, -(-(df.agg(F.sum(row_bytes(df))).first()[0] or 0) // bytes_a_file))


def _stream(spark: SparkSession, d: str, files: int = 4) -> DataFrame:
    """events as a stream, in files of rising time, one a micro-batch."""
    path = scratch(spark, "events")
    load(spark, d, "events").repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(path)
    # Files arrive in order of their modification times; tasks end in any order.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    first = min((s.getModificationTime() for _, s in found), default=0)
    for k, (_, s) in enumerate(found):
        fs.setTimes(s.getPath(), first + 1000 * k, -1)
    return E.stream_files(spark, path, SCHEMAS["events"], 1)


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_files", "SELECT event_id, user_id FROM events")
def stream_files(spark, d):
    return E.run_once(_stream(spark, d).select("event_id", "user_id"), scratch(spark, "st"))


# Batch forms are whole; streams in append mode hold back windows the watermark hasn't closed.
@query("win_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def win_tumbling(spark, d):
    return _ntz(E.tumbling(load(spark, d, "events")).withColumn("total", F.round("total", 6)))


@query("win_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def win_sliding(spark, d):
    return _ntz(E.sliding(load(spark, d, "events")))


_SESSIONS = """
WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s"""


@query("win_session", _SESSIONS)
def win_session(spark, d):
    return _ntz(E.sessions(load(spark, d, "events")))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("st_tumbling", f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= {_CLOSED}")
def st_tumbling(spark, d):
    return _ntz(E.run_once(E.tumbling(_stream(spark, d)), scratch(spark, "st"))).select("start", "event_type", "n")


@query("st_sliding", f"SELECT * FROM (SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start) WHERE start + INTERVAL 1 HOUR <= {_CLOSED}")
def st_sliding(spark, d):
    return _ntz(E.run_once(E.sliding(_stream(spark, d)), scratch(spark, "st")))


@query("st_session", f"SELECT user_id, start, n FROM ({_SESSIONS.replace('count(*) AS n', 'count(*) AS n, max(ts) AS last')}) WHERE last + INTERVAL 30 MINUTE <= {_CLOSED}")
def st_session(spark, d):
    return _ntz(E.run_once(E.sessions(_stream(spark, d)), scratch(spark, "st")))


@query("st_dedup", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
k(user_id, event_type, rn, event_id, last, kept) AS (
  SELECT user_id, event_type, rn, event_id, ts, true FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_type, e.rn, e.event_id, CASE WHEN e.ts >= k.last + INTERVAL 10 MINUTE THEN e.ts ELSE k.last END, e.ts >= k.last + INTERVAL 10 MINUTE
  FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn = k.rn + 1)
SELECT event_id, user_id, event_type FROM k WHERE kept""")
def st_dedup(spark, d):
    """Events but repeats of their user and type within ten minutes; state lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = E.run_once(E.dedup(_stream(spark, d), "user_id", "event_type"), scratch(spark, "st"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.select("event_id", "user_id", "event_type")


@query("st_join", "SELECT p.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'")
def st_join(spark, d):
    return E.run_once(E.view_then_purchase(_stream(spark, d)), scratch(spark, "st"))


@query("st_state", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def st_state(spark, d):
    """The last state of each user; state lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = E.run_once(E.running_totals(_stream(spark, d)), scratch(spark, "st"), "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.groupBy("user_id").agg(F.max_by("n", "n").alias("n"), F.round(F.max_by("total", "n"), 6).alias("total"))


@query("sink_upsert_stream", "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def sink_upsert_stream(spark, d):
    """The last event of each user, kept by merging micro-batches by key; then all batches once more, as after a lost checkpoint, which changes nothing."""
    path, schema = scratch(spark, "upsert"), "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string, value double"
    table = UpsertTable(spark, path, schema, "user_id", ["ts", "event_id"], buckets=16)
    stream = _stream(spark, d)
    for _ in range(2):
        table.drain(stream, scratch(spark, "st"), "events")
    return table.read()


_MIDDLE = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query("st_late", f"SELECT event_type, count(*) AS n, CASE WHEN ts < {_MIDDLE} THEN 'late' ELSE 'in time' END AS route FROM events GROUP BY ALL")
def st_late(spark, d):
    """The newer half of events as a stream, then the older half with the newest minutes: what is late by then is routed, not lost."""
    e = load(spark, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    middle, newest = low + (high - low) / 2, high - timedelta(minutes=5)
    ts, files = F.col("ts"), 4
    path = _arriving(spark, [e.where((ts >= middle) & (ts < newest)), e.where((ts < middle) | (ts >= newest))], files, "late")
    timely, late = E.route_late(E.stream_files(spark, path, SCHEMAS["events"], files), scratch(spark, "routes"))
    counts = lambda df, route: df.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("route", F.lit(route))
    return counts(timely, "in time").unionByName(counts(late, "late"))


@query("st_index", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, md5(substring(text, i * 400 + 1, 500)) AS chunk
FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i
      FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 'v2 ' || text WHEN 'de' THEN '' ELSE text END AS text FROM documents WHERE lang <> 'es') WHERE length(text) > 0)""")
def st_index(spark, d):
    """documents as a stream of files into a chunk index; then French ones revised, German ones emptied, Spanish ones deleted; its current chunks."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text", F.lit(1).alias("v"), F.lit(False).alias("gone"))
    files = _files(docs)
    changed = docs.where("lang <> 'en'").withColumns({"v": F.lit(3), "gone": F.col("lang") == "es", "text": F.expr("case lang when 'fr' then 'v2 ' || text when 'de' then '' else text end")})
    stale = docs.where("lang <> 'en'").withColumns({"v": F.lit(2), "text": F.concat(F.lit("stale and longer "), "text")})
    path, out = _arriving(spark, [docs, changed.union(stale)], files, "docs"), scratch(spark, "index")
    index.stream_index(E.stream_files(spark, path, "doc_id bigint, lang string, text string, v int, gone boolean", files), out, order=F.col("v"), deleted=F.col("gone"))
    return index.current(spark, out).select("doc_id", "chunk_no", F.md5("chunk_text").alias("chunk"))
