"""The flat automaton against looking for every window; what a worker holds."""

import pickle
import random

import numpy as np

from loamstone.llm.decontam import Automaton, Index


def test_equals_looking_for_every_window():
    rng = random.Random(1)
    for trial in range(150):
        window, letters = rng.choice([2, 3, 5]), rng.choice([2, 3, 6])
        items = [(rng.choice(["a", "b", "c", None, str(k)]), [rng.randrange(letters) for _ in range(rng.choice([0, 1, 2, 3, 6, 12]))]) for k in range(rng.randint(1, 8))]
        words = {w for _, ws in items for w in ws}
        made = pickle.loads(pickle.dumps(Automaton(items, window)))
        text = [w for w in (rng.randrange(letters) for _ in range(60)) if w in words]
        hit, found = set(), set()
        for name, ws in items:
            n = min(len(ws), window)
            for i in range(len(ws) - n + 1 if n else 0):
                at = [p for p in range(len(text) - n + 1) if text[p : p + n] == ws[i : i + n]]
                hit.update(q for p in at for q in range(p, p + n))
                found |= {name} if at else set()
        spans, names = made.scan(text)
        assert {q for s, e in spans for q in range(s, e)} == hit and names == found, trial


def test_a_block_is_small():
    rng = np.random.default_rng(1)
    items = [(str(k), rng.integers(0, 2**62, 500).astype(np.uint64) if k % 2 else rng.zipf(1.3, 500).astype(np.uint64)) for k in range(200)]
    assert len(pickle.dumps(Index(items, 13))) < 100_000 * 100  # bytes: 100 a word, of which 500,000 would be 50 MB
