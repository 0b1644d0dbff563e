"""A keyed table that streams and batches are merged into, bucket by bucket.

Layout: data/<attempt>/bucket=<b> holds whole buckets (rows dealt by a hash of the key), and a version of the
manifest names the folder of each bucket and the last batch of each writer. A merge reads the
buckets that its rows fall in, keeps the newest row of each key, and writes those buckets anew; others
keep their files. It counts once its version of the manifest is there, which one writer can make, and a
writer whose version is taken tries again on the newer state. A batch number that a writer has
already merged changes nothing, so a micro-batch that is replayed after a failure does no harm.

The newest row of a key is that of the greatest `version` columns (nulls first); between equal ones the later merge wins, and
within a batch the greater hash of the whole row, so that a rerun decides alike. Rows with a null key are
left out. Rows marked by the `deleted` column stay as marks, so that older rows that come late don't bring
a key back; they are not shown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamstone.sources.manifest import Manifest
from loamstone.sources.tables import fresh


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, version: list[str], *, deleted: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.version, self.deleted, self.buckets = spark, path.rstrip("/"), key, version, deleted, buckets
        empty = spark.createDataFrame([], schema)
        self.schema = empty.schema
        self._bucket, self._age = fresh("bucket", empty), fresh("__age", empty)
        self.manifest = Manifest(spark, self.path)

    def _state(self) -> tuple[int, dict]:
        n, held = self.manifest.last()
        held = held or {"buckets": {}, "batches": {}, "count": self.buckets}
        if held["count"] != self.buckets:
            raise ValueError(f"the table has {held['count']} buckets")
        return n, held

    def _rows(self, held: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = [p for b, p in held["buckets"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        rows = self._rows(self._state()[1])
        return rows.where(~F.coalesce(F.col(f"`{self.deleted}`"), F.lit(False))) if self.deleted else rows

    def _newest(self, rows: DataFrame, age: str | None = None) -> DataFrame:
        """One row a key; partly summed before the shuffle, so a key with most rows isn't one task's."""
        columns = [F.col(f"`{c}`") for c in self.schema.names]
        order = F.struct(*(F.col(f"`{c}`") for c in self.version), F.col(age) if age else F.lit(0), F.xxhash64(*columns))
        best = rows.groupBy(F.col(f"`{self.key}`").alias("k")).agg(F.max_by(F.struct(*columns), order).alias("row"))
        return best.select("row.*")

    def merge(self, rows: DataFrame, writer: str = "batch", batch: int | None = None) -> bool:
        """Put rows in by key; False if this writer's batch of that number is in already. Without a number it is always merged."""
        bucket = F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")
        new = self._newest(rows.select(*(f"`{c}`" for c in self.schema.names)).where(F.col(f"`{self.key}`").isNotNull()))
        attempt = f"data/{uuid.uuid4().hex}"
        new.withColumn(self._bucket, bucket).write.partitionBy(self._bucket).parquet(f"{self.path}/{attempt}-new")
        touched = [n.removeprefix(f"{self._bucket}=") for n in self.manifest.store.names(f"{attempt}-new") if n.startswith(f"{self._bucket}=")]
        new = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{attempt}-new/{self._bucket}={b}" for b in touched)) if touched else self.spark.createDataFrame([], self.schema)
        try:
            while True:
                n, held = self._state()
                if batch is not None and held["batches"].get(writer, -1) >= batch:
                    return False
                out = f"data/{uuid.uuid4().hex}"
                both = self._rows(held, touched).withColumn(self._age, F.lit(0)).unionByName(new.withColumn(self._age, F.lit(1)))
                merged = self._newest(both, self._age).withColumn(self._bucket, bucket)
                if touched:
                    merged.repartition(self._bucket).write.partitionBy(self._bucket).parquet(f"{self.path}/{out}")
                after = {"buckets": held["buckets"] | {b: f"{out}/{self._bucket}={b}" for b in touched}, "batches": held["batches"] | ({writer: batch} if batch is not None else {}), "count": self.buckets}
                if self.manifest.publish(n + 1, after):
                    return True
                self.manifest.store.delete(out)
        finally:
            self.manifest.store.delete(f"{attempt}-new")

    def drain(self, stream: DataFrame, checkpoint: str, writer: str) -> None:
        """Merge every micro-batch of a stream until it has no more."""

        def put(rows: DataFrame, n: int) -> None:
            self.merge(rows, writer, n)

        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def vacuum(self) -> int:
        """Delete buckets that the last version doesn't name; call it while nobody writes or reads an older version. Returns how many folders went."""
        held = {p for p in self._state()[1]["buckets"].values()}
        gone = 0
        for attempt in self.manifest.store.names("data"):
            names = [f"data/{attempt}/{b}" for b in self.manifest.store.names(f"data/{attempt}") if b.startswith(f"{self._bucket}=")]
            old = [n for n in names if n not in held]
            for n in [f"data/{attempt}"] if len(old) == len(names) else old:
                self.manifest.store.delete(n)
                gone += 1
        return gone
