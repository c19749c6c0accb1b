import hashlib
import random

import numpy as np

from llm_data import awkward, corpus, table
from syntabula.llm import shards
from syntabula.llm.common import Scratch
from syntabula.llm.strings import repeated_strings
from syntabula.llm.suffixes import common_prefixes, suffix_array


def brute(rows, length):
    least = {}
    data = [(key, (t or "").encode()) for key, t in rows]
    order = [2**63 - 1 if k is None else k for k, _ in data]
    for o, (_, t) in zip(order, data):
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            least[s] = min(least.get(s, o), o)
    out = []
    for o, (key, t) in zip(order, data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < o:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((key, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length=50):
    with Scratch(spark) as scratch:
        found = repeated_strings(scratch, table(spark, rows), length=length)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in found.collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 1500)
    rows = awkward(2)
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == brute(rows, 50)


def test_random_words_and_passages(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 4000)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = list(enumerate(corpus(5, 60, words, (0, 120))))
    passage = "the same passage of some length that many of the documents hold " * 3
    rows += [(200 + i, f"{rng.random()} {passage[i : 120 + i]} {rng.random()}") for i in range(8)]
    assert got(spark, rows) == brute(rows, 50)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_suffix_order_and_prefixes():
    rng = random.Random(0)
    for _ in range(60):
        text = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 150)))
        order, _ = suffix_array(text, 20)
        key = [(text[i : i + 20] + bytes(20))[:20] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and key == sorted(key)
        shared = common_prefixes(text, order, 20)
        for j in range(1, len(text)):
            a, b = text[order[j - 1] :][:20], text[order[j] :][:20]
            assert shared[j] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    assert (shards.unpack(shards.pack(values)) == values).all() and len(shards.unpack(shards.pack(values[:0]))) == 0
    signed = rng.integers(-(2**62), 2**62, 500)
    assert (shards.unpack_any(shards.pack_any(signed)) == signed).all()
