"""Cues and windows are as many as the sample shows."""

import numpy as np

from loamstone.llm import toxicity


def test_more_cues_than_twenty_thousand(spark):
    words = " ".join(f"q{k}z" for k in range(21_000))
    rows = [(k, 1, f"{words} t{k}") for k in range(12)] + [(100 + k, 0, f"clean text of number n{k}") for k in range(60)]
    cues = toxicity._cues(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert len(cues) > 21_000 and (np.diff(cues.astype(float)) >= 0).all()


def test_rarer_cues_show_once_frequent_ones_are_explained(spark):
    """A second kind of toxic text, too rare to stand out beside the first."""
    rows = [(k, 1, f"awful horrid nasty u{k}") for k in range(60)] + [(200 + k, 1, f"grobes wort v{k}") for k in range(4)] + [(1000 + k, 0, f"fine day w{k}") for k in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, label int, text string")
    data = np.frombuffer(b"grobes awful", np.uint8)
    rare, usual = toxicity.span_hashes(data, np.array([0, 7]), np.array([6, 12]))
    cues = toxicity._cues(sample)
    assert usual in cues and rare in cues


def test_weighted_windows_are_repeated_windows():
    one = [({8: [0]}, True, 1)] * 5 + [({8: [0]}, False, 1)] + [({}, False, 1)] * 40
    many = [({8: [0]}, True, 5), ({8: [0]}, False, 1), ({}, False, 40)]
    a, b = toxicity._fit_chain(one, 1), toxicity._fit_chain(many, 1)
    assert np.allclose(a[0], b[0]) and np.isclose(a[1], b[1]) and np.allclose(a[2], b[2])
