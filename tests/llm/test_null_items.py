"""Benchmark items without an id."""

import duckdb
from harness import table

from loamstone.llm.queries import op6_benchmark_decontamination, oracle_sql


def test_items_without_id_hit_like_others(spark, tmp_path):
    docs = [(1, "so no id at all"), (2, "one two and no id"), (3, "clean text"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "one two"), (None, "no id"), (None, "at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = op6_benchmark_decontamination(spark, str(tmp_path))
    got = df.collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got} == {1: (4, 1, True), 2: (4, 2, True), 3: (0, 0, False), 4: (0, 0, False)}
    sql = oracle_sql()["op6_benchmark_decontamination"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(sql)
    assert table(df.columns, [tuple(r) for r in got]) == table([c[0] for c in want.description], want.fetchall())
