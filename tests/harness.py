"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def data_dir(sf: str = "0.01") -> str:
    return os.environ.get("TESTDATA", "/root/testdata") + f"/sf{sf}"


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, sf_dir: str) -> int:
    """Rows in common; raises where the query and its SQL differ."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    columns, rows = oracle(entry.oracle_sql()[name], sf_dir)
    assert sorted(columns) == sorted(df.columns), (name, sorted(columns), sorted(df.columns))
    mine, theirs = table(df.columns, [tuple(r) for r in df.collect()]), table(columns, rows)
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not wrong, (name, len(wrong), wrong[:3])
    return len(mine)
