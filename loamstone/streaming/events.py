"""Windows, deduplication, joins and state over event streams.

Every function takes a DataFrame that may be a stream or a table; on a table the
watermark is ignored and all windows are closed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamstone.sources.tables import fresh

DELAY = "10 minutes"


def stream_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, a few each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def event_time(events: DataFrame, delay: str = DELAY) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    g = event_time(events).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    g = event_time(events).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n. Don't semi- or anti-join on these rows before writing them; Spark 4.1 pushes such joins too far."""
    g = event_time(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


class FirstWithin(StatefulProcessor):
    """Rows of a key, in order of time, that come no sooner than the delay after the last one kept; a key goes from the state once the watermark is past it.

    Keys (texts in the column `key`) come in buckets, whose state is one value, so that Python is called once a bucket and not once a key.
    """

    def __init__(self, delay: str, key: str, bucket: str, columns: list[str]) -> None:
        self.step, self.key, self.bucket, self.columns = pd.Timedelta(delay) // pd.Timedelta("1us"), key, bucket, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last = {k: t for k, t in self._held().items() if t + self.step >= mark}
        # Names that begin with an underscore come changed, so columns go by their places.
        some = pd.concat(list(rows)).set_axis([*self.columns, self.key, self.bucket], axis=1)
        some = some.sort_values(["ts", *(c for c in self.columns if c != "ts")], kind="stable", ignore_index=True)
        kept = []
        for i, (k, t) in enumerate(zip(some[self.key].tolist(), some["ts"].astype("datetime64[us]").astype("int64").tolist(), strict=True)):
            before = last.get(k)
            if before is None or abs(t - before) >= self.step:
                kept.append(i)
                last[k] = t if before is None else max(before, t)
        self._hold(last)
        if kept:
            yield some.iloc[kept][self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._hold({k: t for k, t in self._held().items() if t + self.step >= mark})
        return iter(())

    def _held(self) -> dict[str, int]:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _hold(self, last: dict[str, int]) -> None:
        """Keep the state, and a timer for when all of it is over."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if last:
            self.state.update((json.dumps(last),))
            self.handle.registerTimer((max(last.values()) + self.step) // 1000 + 1)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def dedup(events: DataFrame, *keys: str, delay: str = DELAY, buckets: int = 1024) -> DataFrame:
    """Rows but those less than the delay after the last kept row of their key (needs the RocksDB state store); a stream's files should rise in time.

    A bucket's rows of a micro-batch are one frame; a checkpoint keeps its number of buckets.
    """
    timed = event_time(events, delay)
    key, bucket = fresh("__key", timed), fresh("__bucket", timed)
    named = timed.withColumn(key, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)))
    return named.groupBy(bucket).transformWithStateInPandas(FirstWithin(delay, key, bucket, timed.columns), timed.schema, "Append", "EventTime")


def view_then_purchase(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Purchases with the same user's views in the time before; both sides are bounded, so state is dropped in time."""
    e = event_time(events)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("view_id"), F.col("ts").alias("vt"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("pt"))
    return v.join(p, F.expr(f"u = user_id AND pt >= vt AND pt <= vt + interval {within}")).select("user_id", "view_id", "purchase_id")


class RunningTotal(StatefulProcessor):
    """Count and sum of values by key over all time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", "n long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each micro-batch (needs the RocksDB state store)."""
    return event_time(events).groupBy("user_id").transformWithStateInPandas(RunningTotal(), "user_id long, n long, total double", "Update", "None")


def route_late(events: DataFrame, path: str, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """Drain a stream into rows in time and rows later than the delay behind the highest time of earlier micro-batches.

    What a watermark would drop is kept and routed. Each micro-batch writes folders of
    its own under its number, its highest time too, so one that runs again after a
    failure replaces itself and sees the same earlier batches.
    """
    spark = events.sparkSession
    late_by = F.expr(f"interval {delay}")

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(F.max(F.col("ts").cast("timestamp")).alias("high"))
        own.write.mode("overwrite").parquet(f"{path}/high/batch={n}")
        high = spark.read.schema("high timestamp, batch long").parquet(f"{path}/high").where(F.col("batch") < n).agg(F.max("high")).first()[0]
        late = F.lit(False) if high is None else F.col("ts").cast("timestamp") < F.lit(high) - late_by
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/timely/batch={n}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={n}")

    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = events.schema
    return tuple(spark.read.schema(schema).parquet(f"{path}/{route}/batch=*") for route in ("timely", "late"))


def run_once(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into Parquet files (append) or the last batch's rows (complete, update), and read it."""
    spark = df.sparkSession
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").start(f"{path}/data").awaitTermination()
        return spark.read.parquet(f"{path}/data")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    out.foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{path}/data")
