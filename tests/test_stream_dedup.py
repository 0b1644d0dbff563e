"""Only repeats within the delay go, in one micro-batch or in many."""

import datetime as dt
from collections import defaultdict

import pytest
from harness import data_dir as data

from loamstone.queries.streams import QUERIES
from loamstone.sources.tables import load
from loamstone.streaming import events as E

RocksDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_within_the_delay_go(spark, tmp_path, batches):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0)), (2, "a", at(4)), (3, "b", at(5)), (4, "a", at(9)), (5, "a", at(11)), (6, "a", at(20)), (7, "a", at(21)), (8, "b", at(90)), (9, "a", at(95))]
    schema = "event_id long, k string, ts timestamp"
    for i in range(3):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", RocksDB)
    try:
        got = E.run_once(E.dedup(E.stream_files(spark, f"{tmp_path}/in", schema, 99 if batches == 1 else 1), "k"), f"{tmp_path}/out").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r.event_id for r in got) == [1, 3, 5, 7, 8, 9]


def test_registered_query_keeps_what_repeats_nothing(spark):
    by = defaultdict(list)
    for r in load(spark, data("0.001"), "events").collect():
        by[r.user_id, r.event_type].append((r.ts, r.event_id))
    want = set()
    for rows in by.values():
        last = None
        for t, i in sorted(rows):
            if last is None or t - last >= dt.timedelta(minutes=10):
                want.add(i)
                last = t
    assert {r.event_id for r in QUERIES["st_dedup"](spark, data("0.001")).collect()} == want and len(want) > len(by)


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_share_calls_and_state(spark, tmp_path, buckets):
    """2,000 keys in a bucket are one call a micro-batch; null keys are keys too."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    keys = [None, *range(2000)]
    schema = "event_id long, k long, ts timestamp"
    for i, m in enumerate((0, 6, 12)):
        spark.createDataFrame([(10_000 * i + n, k, at(m)) for n, k in enumerate(keys)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", RocksDB)
    try:
        got = E.run_once(E.dedup(E.stream_files(spark, f"{tmp_path}/in", schema, 1), "k", buckets=buckets), f"{tmp_path}/out").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r.event_id for r in got) == sorted(10_000 * i + n for i in (0, 2) for n in range(2001))
