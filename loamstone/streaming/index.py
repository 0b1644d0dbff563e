"""Incremental index: documents are chunked and put in by id, version by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.operators.chunking import chunk_chars
from loamstone.sources.connectors import latest
from loamstone.sources.manifest import Store


def stream_index(docs: DataFrame, path: str, size: int = 500, overlap: int = 100, *, order: Column | None = None, deleted: Column | None = None) -> None:
    """Drain a stream of documents (doc_id, text).

    Micro-batches are versions, later ones win. Within a micro-batch the row of the
    highest `order` (a version or time; without one the greatest text, which is at
    least the same on every run) is a document's newest. Rows that `deleted` marks take
    a document out. Every document of a micro-batch leaves a row of its version, with or
    without chunks, so that emptied and deleted ones no longer show older chunks. Each
    micro-batch writes folders of its own, so one that runs again replaces itself.
    """
    rows = docs.select("doc_id", "text", (F.lit(0) if order is None else order).alias("order"), F.coalesce(F.lit(False) if deleted is None else deleted, F.lit(False)).alias("deleted"))

    def put(batch: DataFrame, n: int) -> None:
        newest = latest(batch, "doc_id", "order", "deleted", "text")
        stamp = F.lit(n).cast("long").alias("version")
        newest.select("doc_id", stamp, "deleted").write.mode("overwrite").parquet(f"{path}/versions/batch={n}")
        chunk_chars(newest.where("not deleted"), size, overlap).withColumn("version", stamp).write.mode("overwrite").parquet(f"{path}/chunks/batch={n}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


CHUNKS = "doc_id bigint, chunk_no int, start int, end int, chunk_text string, version bigint"


def current(spark, path: str) -> DataFrame:
    """The chunks of each document's last version; one aggregate and a join, no window over whole documents."""
    versions = spark.read.schema("doc_id bigint, version bigint, deleted boolean").parquet(f"{path}/versions/batch=*")
    last = versions.groupBy("doc_id").agg(F.max("version").alias("version"))
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks/batch=*").join(last, ["doc_id", "version"], "left_semi")


def vacuum(spark, path: str) -> int:
    """Delete the folders of micro-batches that hold no document's last version; call it while nobody reads the index. Returns how many went."""
    store = Store(spark, path)
    versions = spark.read.schema("doc_id bigint, version bigint, deleted boolean").parquet(f"{path}/versions/batch=*")
    held = {r.version for r in versions.groupBy("doc_id").agg(F.max("version").alias("version")).select("version").distinct().collect()}
    old = [n for n in store.names("versions") if n.startswith("batch=") and int(n.removeprefix("batch=")) not in held]
    for n in old:
        store.delete(f"chunks/{n}")
        store.delete(f"versions/{n}")
    return len(old)
