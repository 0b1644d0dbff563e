"""Commits and compactions that race, and drivers that die."""

import pytest

from loamstone.llm.token_counts import TokenLedger

ROW = "source string, lang string, tokenizer string, docs long, tokens long"


@pytest.fixture
def ledger(spark, tmp_path):
    return TokenLedger(spark, f"file://{tmp_path}/ledger")


def change(spark, docs, tokens, source="s"):
    return spark.createDataFrame([(source, "en", "words", docs, tokens)], ROW)


def totals(ledger):
    return {r.source: (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def test_overlapping_compactions_count_once(spark, ledger, monkeypatch):
    ledger.commit("one", change(spark, 2, 10))
    other = TokenLedger(spark, ledger.path)
    publish, done = TokenLedger._publish, []

    def late(self, name, content):
        if self is ledger and not done and "/generations/" in name:
            done.append(other.compact())  # a second compaction begins and ends while the first one is under way
        return publish(self, name, content)

    monkeypatch.setattr(TokenLedger, "_publish", late)
    assert ledger.compact() is False and done == [True]
    assert totals(ledger) == totals(other) == {"s": (2, 10)}
    ledger.commit("two", change(spark, 1, 5))
    assert ledger.compact() and totals(ledger) == {"s": (3, 15)}


def test_commits_during_a_compaction_are_kept(spark, ledger, monkeypatch):
    ledger.commit("one", change(spark, 2, 10))
    publish = TokenLedger._publish

    def late(self, name, content):
        if "/generations/" in name:
            monkeypatch.setattr(TokenLedger, "_publish", publish)
            assert self.commit("two", change(spark, 1, 7, "t"))
        return publish(self, name, content)

    monkeypatch.setattr(TokenLedger, "_publish", late)
    assert ledger.compact()
    assert totals(ledger) == {"s": (2, 10), "t": (1, 7)}
    assert not ledger.commit("one", change(spark, 2, 10)) and not ledger.commit("two", change(spark, 1, 7, "t"))


def test_two_attempts_at_a_batch_count_once(spark, ledger, monkeypatch):
    other, publish, done = TokenLedger(spark, ledger.path), TokenLedger._publish, []

    def late(self, name, content):
        if self is ledger:
            done.append(other.commit("load", change(spark, 2, 10)))
        return publish(self, name, content)

    monkeypatch.setattr(TokenLedger, "_publish", late)
    assert ledger.commit("load", change(spark, 2, 10)) is False and done == [True]
    assert totals(ledger) == {"s": (2, 10)}


def test_many_rounds_leave_one_generation_behind(spark, ledger, tmp_path):
    for k in range(4):
        assert ledger.commit(f"b{k}", change(spark, 1, k)) and ledger.compact()
        assert not ledger.commit("b0", change(spark, 1, 0))
    assert totals(ledger) == {"s": (4, 6)}
    assert len(list((tmp_path / "ledger/deltas").iterdir())) == 1 and len(list((tmp_path / "ledger/folded").iterdir())) == 2
    assert ledger.commit("gone", change(spark, -4, -6)) and ledger.totals().count() == 0


def test_empty_ledger_and_empty_batch(spark, ledger):
    assert ledger.totals().count() == 0 and ledger.compact() and ledger.totals().count() == 0
    assert ledger.commit("none", change(spark, 1, 1).limit(0)) and ledger.compact() and ledger.totals().count() == 0
