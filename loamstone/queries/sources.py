"""Scans, connectors, sinks and Python function kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.sources import connectors
from loamstone.sources.tables import SCHEMAS, load, load_binary, load_pruned, load_text, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("scan_parquet", "SELECT * FROM supplier")
def scan_parquet(spark, d):
    return load(spark, d, "supplier")


@query("scan_pruned", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars > 30")
def scan_pruned(spark, d):
    return load_pruned(spark, d, "documents", ["doc_id", "source"], (F.col("lang") == "en") & (F.col("n_chars") > 30))


@query("scan_json_lines", "SELECT * FROM part")
def scan_json_lines(spark, d):
    path = scratch(spark, "json")
    load(spark, d, "part").write.json(path)
    return load_text(spark, path, "json", SCHEMAS["part"])


@query("scan_csv", "SELECT * FROM customer")
def scan_csv(spark, d):
    path = scratch(spark, "csv")
    load(spark, d, "customer").write.csv(path, header=True)
    return load_text(spark, path, "csv", SCHEMAS["customer"], header="true")


@query("scan_text", "SELECT r_name AS value FROM region")
def scan_text(spark, d):
    path = scratch(spark, "text")
    load(spark, d, "region").select("r_name").write.text(path)
    return load_text(spark, path, "text")


@query("scan_orc", "SELECT * FROM nation")
def scan_orc(spark, d):
    path = scratch(spark, "orc")
    load(spark, d, "nation").write.orc(path)
    return spark.read.schema(SCHEMAS["nation"]).orc(path)


@query("scan_binary", "SELECT CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS bytes, true AS whole FROM pages")
def scan_binary(spark, d):
    """Whole files with their sizes: the pages' text, each ended by one byte, written out and read back."""
    path = scratch(spark, "binary")
    load(spark, d, "pages").select("html").write.text(path, lineSep="\x1e")
    files = load_binary(spark, path, "part-*")
    return files.agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.every(F.col("length") == F.octet_length("content")).alias("whole"))


@query("custom_source", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def custom_source(spark, d):
    """orders through the plug-in source, a row group a partition."""
    connectors.register(spark)
    rows = spark.read.format("row_groups").schema("o_orderkey long, o_totalprice double").option("path", f"{d}/orders.parquet").load()
    return rows.where("o_totalprice > 200000")


@query("sink_parquet", "SELECT * FROM documents")
def sink_parquet(spark, d):
    path = scratch(spark, "parquet")
    connectors.write_partitioned(load(spark, d, "documents"), path, "lang")
    return spark.read.schema(SCHEMAS["documents"]).parquet(path).select("doc_id", "text", "lang", "source", "n_chars")


@query("sink_upsert", """
WITH n AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_orderdate, o.o_orderdate) AS o_orderdate FROM orders o LEFT JOIN n USING (o_orderkey)""")
def sink_upsert(spark, d):
    old = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    new = old.where("o_orderpriority = '1-URGENT'").withColumns({"o_orderstatus": F.lit("X"), "o_orderdate": F.expr("o_orderdate + interval 1 day")})
    return connectors.upsert(old, new, "o_orderkey", "o_orderdate").drop("o_orderpriority")


# Python function kinds.
@query("udf_scalar", "SELECT n_nationkey, upper(n_name) || '!' AS v FROM nation")
def udf_scalar(spark, d):
    shout = F.udf(lambda s: s.upper() + "!", "string")
    return load(spark, d, "nation").select("n_nationkey", shout("n_name").alias("v"))


@query("udf_vectorized", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def udf_vectorized(spark, d):
    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(net("l_extendedprice", "l_discount"), 4).alias("net"))


@query("udf_map", "SELECT event_id, value * 2 AS v FROM events WHERE value > 10")
def udf_map(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("value").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(v * 2)], names=["event_id", "v"]).filter(pa.array(v > 10))

    return load(spark, d, "events").select("event_id", "value").mapInArrow(run, "event_id long, v double")


@query("udf_group", "SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")
def udf_group(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "n": [len(pdf)], "spread": [round(pdf["value"].max() - pdf["value"].min(), 6)]})

    return load(spark, d, "events").select("user_id", "value").groupBy("user_id").applyInPandas(run, "user_id long, n long, spread double")


#: Rows of a group that one worker gets about.
PART_ROWS = 50_000


def _in_parts(events: DataFrame) -> DataFrame:
    """events with a part by hash, as many as the rows ask for, so that no worker gets a whole group."""
    return events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(max(-(-events.count() // PART_ROWS), 4))))


@query("udaf", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type")
def udaf(spark, d):
    """A Python aggregate over parts of each group; sums of its results make the group's."""

    @F.pandas_udf("double")
    def squares(v: pd.Series) -> float:
        return float((v * v).sum())

    parts = _in_parts(load(spark, d, "events").where("value is not null")).withColumn("one", F.lit(1.0)).groupBy("event_type", "part").agg(squares("value").alias("s"), squares("one").alias("n"))
    return parts.groupBy("event_type").agg(F.round(F.sqrt(F.sum("s") / F.sum("n")), 6).alias("rms"))


@query("udtf", "SELECT n_nationkey, CAST(i AS INTEGER) AS i, n_name[i:i] AS c FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def udtf(spark, d):
    @F.udtf(returnType="i int, c string")
    class Letters:
        def eval(self, s: str):
            yield from enumerate(s, 1)

    spark.udtf.register("letters", Letters)
    load(spark, d, "nation").createOrReplaceTempView("__udtf_nation")
    return spark.sql("SELECT n_nationkey, l.i, l.c FROM __udtf_nation, LATERAL letters(n_name) l")


@query("udf_arrow", "SELECT p_partkey, round(p_retailprice * p_size, 4) AS v FROM part")
def udf_arrow(spark, d):
    """Arrow arrays in and out, no pandas between."""

    @F.arrow_udf("double")
    def times(price: pa.Array, size: pa.Array) -> pa.Array:
        return pc.multiply(price, pc.cast(size, pa.float64()))

    return load(spark, d, "part").select("p_partkey", F.round(times("p_retailprice", "p_size"), 4).alias("v"))


@query("udf_group_arrow", "SELECT event_type, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def udf_group_arrow(spark, d):
    """A Python function over parts of each group; their extremes and counts make the group's."""

    def run(table: pa.Table) -> pa.Table:
        low, high = pc.min_max(table.column("value")).as_py().values()
        return pa.table({"event_type": [table.column("event_type")[0].as_py()], "n": pa.array([table.num_rows], pa.int64()), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    parts = _in_parts(load(spark, d, "events").select("event_id", "event_type", "value")).groupBy("event_type", "part").applyInArrow(run, "event_type string, n long, low double, high double")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.max("high") - F.min("low"), 6).alias("spread"))


@query("udtf_arrow", "SELECT s_suppkey, unnest([s_suppkey * 2, s_suppkey * 3]) AS v FROM supplier")
def udtf_arrow(spark, d):
    """A table function that takes a table as Arrow batches."""

    @F.arrow_udtf(returnType="s_suppkey bigint, v bigint")
    class Multiples:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            key = rows.column("s_suppkey")
            for k in (2, 3):
                yield pa.table({"s_suppkey": key, "v": pc.multiply(key, k)})

    spark.udtf.register("multiples", Multiples)
    load(spark, d, "supplier").select("s_suppkey").createOrReplaceTempView("__udtf_supplier")
    return spark.sql("SELECT * FROM multiples(TABLE(SELECT * FROM __udtf_supplier))")
