"""The registered ledger query runs every kind of delta, and its totals are those of the table."""

import duckdb
from harness import data_dir as data

from loamstone.llm import token_counts
from loamstone.llm.queries import TOKENIZERS, op3_token_counts


def test_query_revises_withdraws_and_compacts(spark, monkeypatch):
    signs, compactions = {}, []
    commit, compact = token_counts.TokenLedger.commit, token_counts.TokenLedger.compact

    def watched(self, batch, signed):
        docs = signed.selectExpr("sum(docs) d", "count_if(docs < 0) n").first()
        done = commit(self, batch, signed)
        signs.setdefault(batch, (docs.d, docs.n, done))
        return done

    monkeypatch.setattr(token_counts.TokenLedger, "commit", watched)
    monkeypatch.setattr(token_counts.TokenLedger, "compact", lambda self: compactions.append(compact(self)))
    got = sorted(map(str, op3_token_counts(spark, data("0.001")).collect()))
    assert signs == {"load": (400, 0, True), "revise": (0, 400, True), "again": (400, 0, True), "withdraw": (-400, 400, True)} and len(compactions) == 1
    docs = spark.read.parquet(data("0.001") + "/documents.parquet")
    kinds = [token_counts.ByteBpe("byte_bpe_50k", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), token_counts.Words()]
    token_counts.count_tokens(docs, kinds).createOrReplaceTempView("ledger_counts")
    want = spark.sql("SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n_tokens) AS n_tokens FROM ledger_counts GROUP BY ALL")
    assert got == sorted(map(str, want.collect()))
    # The words' rows once more, by SQL alone.
    sql = r"SELECT source, lang, count(*) AS n, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS t FROM read_parquet('{}') GROUP BY ALL".format(data("0.001") + "/documents.parquet")
    words = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op3_token_counts(spark, data("0.001")).where("tokenizer = 'words'").collect()}
    assert words == {(a, b): (n, t) for a, b, n, t in duckdb.sql(sql).fetchall()}
