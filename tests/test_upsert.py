"""Streams merged by key: replays, late and deleted rows, equal versions, untouched buckets, two writers."""

import pytest

from loamstone.sources.manifest import Manifest
from loamstone.sources.upsert import UpsertTable
from loamstone.streaming import events as E

SCHEMA = "k long, v int, text string, gone boolean, __age string, row string, bucket string"


def frame(spark, *rows):
    return spark.createDataFrame([(k, v, text, gone, "a", "b", "c") for k, v, text, gone in rows], SCHEMA)


def table(spark, path, **how):
    return UpsertTable(spark, f"file://{path}/t", SCHEMA, "k", ["v"], deleted="gone", **{"buckets": 8} | how)


def held(t):
    rows = t.read().collect()
    assert all((r["__age"], r["row"], r["bucket"]) == ("a", "b", "c") for r in rows)
    return {r.k: r.text for r in rows}


def files(t):
    return {b: (p, sorted(t.manifest.store.names(p))) for b, p in t._state()[1]["buckets"].items()}


def test_newest_row_of_each_key(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == {} and t.merge(frame(spark)) and held(t) == {}
    t.merge(frame(spark, (1, 1, "one", False), (2, 5, "two", False), (None, 1, "no key", False), (3, None, "no version", None)))
    assert held(t) == {1: "one", 2: "two", 3: "no version"}
    t.merge(frame(spark, (1, 3, "new", False), (1, 2, "old", False), (2, 4, "late", False), (3, 0, "version", False), (4, 1, "four", False)))
    assert held(t) == {1: "new", 2: "two", 3: "version", 4: "four"}
    t.merge(frame(spark, (1, 3, "same version, later", False), (2, 6, None, True)))
    assert held(t) == {1: "same version, later", 3: "version", 4: "four"}
    t.merge(frame(spark, (2, 5, "older than its deletion", False)))
    assert 2 not in held(t)
    t.merge(frame(spark, (2, 7, "back", False)))
    assert held(t)[2] == "back"
    with pytest.raises(ValueError):
        table(spark, tmp_path, buckets=4).read()


def test_equal_versions_in_one_batch_decide_alike(spark, tmp_path):
    rows = [(1, 1, f"t{k}", False) for k in range(20)]
    got = []
    for name, some in (("x", rows), ("y", rows[::-1])):
        t = table(spark, tmp_path / name)
        t.merge(frame(spark, *some).repartition(5))
        got.append(held(t))
    assert got[0] == got[1] and len(got[0]) == 1


def test_replays_and_untouched_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.merge(frame(spark, *((k, 1, "a", False) for k in range(100))), "s", 0)
    before = files(t)
    one = frame(spark, (7, 2, "b", False))
    assert t.merge(one, "s", 1)
    after = files(t)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    versions = t.manifest.store.names("versions")
    assert not t.merge(one, "s", 1) and not t.merge(frame(spark, (7, 9, "c", False)), "s", 0)
    assert files(t) == after and t.manifest.store.names("versions") == versions and held(t)[7] == "b"
    assert t.merge(frame(spark, (8, 9, "c", False)), "another", 0) and held(t)[8] == "c"
    assert t.vacuum() > 0 and held(t) == {**{k: "a" for k in range(100)}, 7: "b", 8: "c"} and t.vacuum() == 0


def test_a_stream_that_is_replayed_whole(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    for part in range(4):
        frame(spark, *((k, part, f"p{part}", part == 3 and k == 5) for k in range(part, 10))).coalesce(1).write.mode("append").parquet(path)
    t = table(spark, tmp_path)
    t.drain(E.stream_files(spark, path, SCHEMA), f"{tmp_path}/c1", "s")
    want = {0: "p0", 1: "p1", 2: "p2", **{k: "p3" for k in range(3, 10) if k != 5}}
    assert held(t) == want
    state = t._state()
    t.drain(E.stream_files(spark, path, SCHEMA), f"{tmp_path}/c2", "s")  # its checkpoint lost: all batches once more
    assert t._state() == state and held(t) == want


def test_a_writer_that_comes_second_merges_into_the_newer_state(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.merge(frame(spark, (1, 1, "a", False)))
    real, between = Manifest.publish, [True]

    def publish(self, version, content):
        if between:
            between.clear()
            other.merge(frame(spark, (1, 2, "other", False), (2, 1, "b", False)))
        return real(self, version, content)

    monkeypatch.setattr(Manifest, "publish", publish)
    assert t.merge(frame(spark, (1, 3, "mine", False), (3, 1, "c", False)))
    assert held(t) == {1: "mine", 2: "b", 3: "c"}
