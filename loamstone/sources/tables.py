"""Fixed schemas, readers by format, and a shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_pruned(spark: SparkSession, sf_dir: str, name: str, columns: list[str], where: Column) -> DataFrame:
    """Column subset and predicate, both of which reach the Parquet scan."""
    return load(spark, sf_dir, name).where(where).select(*columns)


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or SCHEMAS:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def load_text(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options: str) -> DataFrame:
    """json (lines), csv or text under a declared schema; no inference pass."""
    reader = spark.read.options(**options)
    if fmt == "text":
        return reader.text(path)
    if not schema:
        raise ValueError("a schema is needed")
    return reader.schema(schema).format(fmt).load(path)


def load_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and content of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local temporary one only where that is unset and the master local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="loamstone-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Folders named by `scratch` in this process.
_made: list[str] = []


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Delete what queries have left in folders of `scratch`, but for those that `keep` names; call it once their results are written. Returns how many."""
    gone = [p for p in _made if p not in keep]
    for p in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(p)
    return len(gone)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and binaries by their length, arrays by their elements, other nested values by their JSON."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.greatest(F.size(c), F.lit(0)) * 8 + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16)
        else:
            parts.append(F.lit(8))
    return sum(parts, F.lit(16)).cast("long")


def small_enough(df: DataFrame, most_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> bool:
    """Whether df has at most so many rows and bytes; reads no more rows than it must to tell."""
    some = df.limit(most_rows + 1)
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(row_bytes(some)), F.lit(0))).first()
    return n <= most_rows and size <= most_bytes


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only for a side of checked rows and bytes; a larger one is left to a shuffle."""
    return F.broadcast(df) if small_enough(df, most_rows, most_bytes) else df
