"""Replies that are lost, shards that are lost, and ids that repeat in a sample."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import langid, lm, samples
from loamstone.llm.token_counts import TokenLedger
from loamstone.sources.manifest import Store

ROW = "source string, lang string, tokenizer string, docs long, tokens long"


@pytest.fixture
def ledger(spark, tmp_path):
    return TokenLedger(spark, f"file://{tmp_path}/ledger")


def change(spark, docs, tokens):
    return spark.createDataFrame([("s", "en", "words", docs, tokens)], ROW)


def totals(ledger):
    return [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()]


@pytest.fixture
def lossy(monkeypatch):
    """Naming a file takes effect, and then its reply is lost."""
    real = Store._put

    def lost(self, part, to):
        real(self, part, to)
        raise OSError("the reply is lost")

    monkeypatch.setattr(Store, "_put", lost)


def test_a_commit_whose_reply_is_lost_counts(spark, ledger, lossy):
    assert ledger.commit("load", change(spark, 2, 10)) and totals(ledger) == [(2, 10)]
    assert not ledger.commit("load", change(spark, 2, 10)) and totals(ledger) == [(2, 10)]
    assert ledger.compact() and totals(ledger) == [(2, 10)]
    assert ledger.commit("more", change(spark, 1, 1)) and ledger.compact() and totals(ledger) == [(3, 11)]
    assert not ledger.commit("load", change(spark, 2, 10)) and not ledger.commit("more", change(spark, 1, 1))


def test_a_commit_that_fails_leaves_nothing(spark, ledger, monkeypatch):
    monkeypatch.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("nothing done")))
    with pytest.raises(OSError):
        ledger.commit("load", change(spark, 2, 10))
    monkeypatch.undo()
    assert totals(ledger) == [] and ledger.commit("load", change(spark, 2, 10)) and totals(ledger) == [(2, 10)]


def test_markers_of_folded_batches_go_and_still_count_once(spark, ledger, tmp_path, monkeypatch):
    for k in range(3):
        assert ledger.commit(f"b{k}", change(spark, 1, 1)) and ledger.compact()
    assert sorted(p.name for p in (tmp_path / "ledger/commits").iterdir() if p.suffix != ".crc") == ["b2"]
    assert not any(ledger.commit(f"b{k}", change(spark, 1, 1)) for k in range(3)) and totals(ledger) == [(3, 3)]
    # An attempt that began before the batch was there and ends after its marker is gone.
    late, seen = TokenLedger(spark, ledger.path), []
    folded = TokenLedger._folded
    monkeypatch.setattr(TokenLedger, "_folded", lambda self, batch, but=None: folded(self, batch, but) if seen or seen.append(1) else False)
    assert not late.commit("b0", change(spark, 1, 1)) and seen
    assert totals(ledger) == [(3, 3)] and ledger.compact() and totals(ledger) == [(3, 3)]


def test_a_lost_or_short_shard_raises(spark, tmp_path):
    keys = np.arange(5, dtype=np.uint64) + 7
    table = lm.Table(str(tmp_path / "none"), [5])
    with pytest.raises(OSError):
        table.find(keys)
    held = tmp_path / "held"
    lm._write(str(held / "0"), [keys])
    lm._write(str(held / "0.a"), [np.arange(5, dtype=np.uint8)])
    table = lm.Table(str(held), [5])
    assert table.find(keys).tolist() == [0, 1, 2, 3, 4] and table.column("a", np.arange(5)).tolist() == [0, 1, 2, 3, 4]
    lm._mapped.cache_clear()
    for name, size, look in (("0", 39, lambda: table.find(keys)), ("0.a", 4, lambda: table.column("a", np.arange(5)))):
        os.truncate(held / name, size)
        with pytest.raises(OSError, match="cut short"):
            look()
    os.remove(held / "0.a")
    with pytest.raises(OSError):
        table.column("a", np.arange(5))


def test_a_scored_text_needs_every_shard(spark, tmp_path):
    """A copy of the model, as workers may still map the first one's files, without one shard that holds keys."""
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in range(30)], "doc_id long, text string")
    model = lm.train(docs)
    tables = model.tables
    for k, t in enumerate(tables):
        shutil.copytree(lm._local(t.path), tmp_path / str(k))
        t.path = str(tmp_path / str(k))
    assert lm.score(docs, model).count() == 30
    for k, t in enumerate(tables):
        shutil.copytree(t.path, tmp_path / f"again{k}")
        t.path = str(tmp_path / f"again{k}")
    gone = next(f for f in sorted(os.listdir(tables[0].path)) if f.isdigit() and os.path.getsize(f"{tables[0].path}/{f}"))
    os.remove(f"{tables[0].path}/{gone}")
    with pytest.raises(Exception, match=f"again0/{gone}"):
        lm.score(docs, model).collect()


def test_rows_of_a_sample_are_bounded(spark):
    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7000).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert samples.labelled(docs, labels, "quality", bound=10, n=3, out=9).count() == 10
    assert samples.labelled(docs, labels, "quality", bound=10, n=3, out=9, clean_bound=5).count() == 15
    one = samples.labelled(docs, labels, "quality", bound=10, n=3, out=9).collect()
    assert sorted(one) == sorted(samples.labelled(docs.repartition(7), labels, "quality", bound=10, n=3, out=9).collect())
    assert langid.train(docs, out=9, bound=10).langs == ["en"]
