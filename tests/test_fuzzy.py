"""Deletion neighbourhoods against the distance of every pair."""

import random

import pytest

from loamstone.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_equals_every_pair(spark, most):
    rng = random.Random(most)
    make = lambda: "".join(rng.choice("abcé漢") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 12, 40])))
    words = {make() for _ in range(120)}
    words |= {w[:k] + "a" + w[k + 1 :] for w in words for k in (1, len(w) - 1) if len(w) > 2} | {"b" + w for w in words} | {w[1:] for w in words}
    asked = sorted(words)[::3]
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string")
    got = {(r.asked, r.term): r.distance for r in fuzzy.near_terms(df(asked), df(words), most).collect()}
    assert got == {(a, b): d for a in asked for b in words if (d := distance(a, b)) <= most}


def test_no_cross_join_and_no_python(spark):
    df = spark.createDataFrame([("abc",)], "term string").repartition(2)
    plan = fuzzy.near_terms(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "ArrowEvalPython" not in plan


def test_many_prefixes(spark):
    df = lambda *ws: spark.createDataFrame([(w,) for w in ws], "term string")
    got = sorted(map(tuple, fuzzy.starting_with(df("license", "licence", "lid", "a"), df("li", "licen", "a", "b", "a")).collect()))
    assert got == [("a", "a"), ("li", "licence"), ("li", "license"), ("li", "lid"), ("licen", "licence"), ("licen", "license")]
    assert fuzzy.starting_with(df("a"), df("a").limit(0)).count() == 0
