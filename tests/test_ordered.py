"""Ranks, percentiles, modes and overlaps against plain Python and Spark's own windows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamstone.operators import intervals, ordered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_equal_windows(spark, descending):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([0.5] * 4 + [None, 1.5, 2.5, float("nan"), *range(30)]), k, "kept") for k in range(900)]
    df = spark.createDataFrame([(g, None if v is None else float(v), k, x) for g, v, k, x in data], "g string, v double, id long, __key string")
    w = Window.partitionBy("g").orderBy(F.desc("v") if descending else F.asc("v"))
    want = df.select("id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))
    for ranges in (1, 7, 40):
        got = ordered.ranks(df, ["g"], ["v"], descending=descending, tiles=7, ranges=ranges)
        assert got.columns == ["g", "v", "id", "__key", "rn", "rk", "dr", "tile", "pr", "cd"]
        assert rows(got.select("id", "rk", "dr", F.round("pr", 9), F.round("cd", 9))) == [(a, b, c, d, e) for a, b, c, d, e in rows(want)]
        for r in got.groupBy("g").agg(F.collect_list(F.struct("rn", "rk", "tile", "__key")).alias("xs"), F.count("*").alias("n")).collect():
            xs = sorted(r.xs)
            assert [x.rn for x in xs] == list(range(1, r.n + 1)) and [x.rk for x in xs] == sorted(x.rk for x in xs) and {x["__key"] for x in xs} == {"kept"}
            sizes = [sum(x.tile == t for x in xs) for t in range(1, 8)]
            assert [x.tile for x in xs] == sorted(x.tile for x in xs) and sizes == [r.n // 7 + (t < r.n % 7) for t in range(7)]
    assert ordered.ranks(df.limit(0), ["g"], ["v"]).count() == 0


def test_a_group_is_many_tasks_work(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), F.lit(1).alias("v"), "id")
    got = ordered.ranks(df, ["g"], ["v"], ranges=20)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 5001)) and {(r.rk, r.dr, r.cd) for r in got.collect()} == {(1, 1, 1.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__at" in plan.split("Window")[1]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_percentiles_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "RANKED", most)
    monkeypatch.setattr(ordered, "CUTS", 8)
    rng = np.random.default_rng(3)
    groups = {"a": rng.standard_normal(3000).tolist(), "hot": [1.0] * 2500 + rng.random(800).tolist(), None: [5.0], "two": [1.0, 2.0], "same": [7.0] * 50, "neg": (-rng.exponential(1, 500)).tolist()}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: [r[f"p{i}"] for i in range(6)] for r in ordered.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, shares), rtol=0, atol=1e-12), g
    assert ordered.percentiles(df.limit(0), ["g"], "v", shares).count() == 0
    assert ordered.percentiles(df, [], "v", [0.5]).first().p0 == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_modes(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("a", 2), ("b", None), ("b", 9), (None, 4)], "g string, v int")
    assert {r.g: r.mode for r in ordered.mode(df, ["g"], "v").collect()} == {"a": 1, "b": 9, None: 4}


def test_overlaps_equal_every_pair(spark):
    rng = random.Random(5)

    def some(n):
        out = [(k, rng.choice(["x", "y", None]), (s := rng.randint(-500, 500)), s + rng.choice([0, 1, 1, 2, 3, 7, 8, 9, 64, 300, -4])) for k in range(n)]
        return out + [(n, "x", -(10**15), 10**15), (n + 1, "x", None, 5), (n + 2, "y", 0, None), (n + 3, "y", -(2**40), 3), (n + 4, "x", 500, 501)]

    a, b = some(150), some(150)
    schema = "id long, k string, start long, end long"
    for on in (["k"], []):
        got = intervals.overlaps(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema), on)
        pairs = [(r.l.id, r.r.id) for r in got.collect()]
        want = [(x[0], y[0]) for x in a for y in b if None not in (x[2], x[3], y[2], y[3]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3] and (not on or (x[1] is not None and x[1] == y[1]))]
        assert sorted(pairs) == sorted(want) and len(want) > 300
    assert intervals.overlaps(spark.createDataFrame(a, schema).limit(0), spark.createDataFrame(b, schema), ["k"]).count() == 0
