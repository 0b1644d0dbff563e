"""What operators leave in the shared folder, and its release."""

from pathlib import Path

from loamstone.llm import common, minhash
from loamstone.llm.components import components


def folders(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_rounds_are_deleted_and_the_rest_released(spark):
    before = folders(spark)
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    got = components(chain, "a", "b", "rounds")
    assert {r.component for r in got.collect()} == {0}
    assert len([n for n in folders(spark) - before if n.startswith("rounds")]) == 1
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k // 2}") for k in range(10)], "doc_id long, text string")
    assert minhash.near_duplicates(docs).where("kept").count() == 5
    left = folders(spark) - before
    assert 0 < len(left) <= 14 and common.release(spark) >= len(left)
    assert not folders(spark) & left and common.release(spark) == 0
