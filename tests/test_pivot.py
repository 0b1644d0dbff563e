"""No document is lost from the pivot, whatever its source."""

from loamstone.queries.relational import QUERIES


def test_counts_sum_to_the_table(spark, tmp_path):
    rows = [(1, "a", "en", "src0"), (2, "a", "en", "other.site"), (3, "a", None, None), (None, "a", "fr", "src19"), (5, "a", "en", "src0")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: r.asDict() for r in QUERIES["pivot"](spark, str(tmp_path)).collect()}
    assert (got["en"]["src0"], got["en"]["other.site"], got[None]["null"], got["fr"]["src19"]) == (2, 1, 1, 1)
    assert sum(v for r in got.values() for k, v in r.items() if k != "lang") == len(rows)
