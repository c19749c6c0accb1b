import hashlib
import random
from collections import Counter

import numpy as np

from llm_data import awkward, corpus, table
from syntabula.llm import shards
from syntabula.llm.common import Scratch
from syntabula.llm.words import Words, recompress, repeated_windows, window_names


def brute(rows, window):
    data = [(key, (t or "").encode().split()) for key, t in rows]
    times = Counter(tuple(w[i : i + window]) for _, w in data for i in range(len(w) - window + 1))
    out = []
    for key, w in data:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, window=35):
    with Scratch(spark) as scratch:
        found = repeated_windows(scratch, table(spark, rows), window=window).collect()
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 1500)
    rows = awkward(3)
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == brute(rows, 35)


def test_passages_runs_and_many_words(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 4000)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = list(enumerate(corpus(7, 60, words, (0, 150))))
    passage = [rng.choice(words) for _ in range(55)]
    rows += [(300 + i, " ".join([rng.choice(words) for _ in range(9)] + passage[i % 3 :] + [rng.choice(words)])) for i in range(6)]
    rows += [(400, "run " * 60), (401, "run " * 36 + "x"), (402, ("one two " * 40))]
    assert got(spark, rows) == brute(rows, 35)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_equal_words_bring_equal_symbols():
    rng = random.Random(3)
    for _ in range(30):
        words = [str(rng.randrange(6)).encode() for _ in range(40)]
        sides = [[str(rng.randrange(6)).encode() for _ in range(30)] for _ in range(4)]
        held = []
        for a, b in (sides[:2], sides[2:]):
            w = Words([b" ".join(a + words + b)])
            symbol, _, low, high = recompress(w.names, w.inside)
            start = 1 + len(a)
            held.append({(int(s), int(x) - start) for s, x, y in zip(symbol, low, high) if x >= start and y <= start + 40})
        assert held[0] == held[1]


def test_window_names_depend_on_order():
    names = np.arange(1, 60, dtype=np.uint64)
    assert len(set(window_names(names, 35).tolist())) == 25 and len(window_names(names[:10], 35)) == 0
    assert window_names(names, 35)[0] != window_names(names[::-1].copy(), 35)[-1]
