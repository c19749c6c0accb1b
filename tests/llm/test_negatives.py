"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from syntabula.llm import negatives
from syntabula.llm.common import Scratch
from syntabula.llm.negatives import Block, candidates, hard_negatives, scores, shifted

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("id", "vector", "shard", "asks", "block", "kind", "rank", "n")],
    ]
)


def made(seed, n=900, width=20, labels=3, spread=0.3):
    """Rows around a few centres; most labels follow the centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width)) * 0.2 + 0.1
    which = rng.integers(0, labels, n)
    vectors = (centres[which] + rng.normal(size=(n, width)) * 0.2 * spread).astype(np.float32)
    given = np.where(rng.random(n) < 0.15, rng.integers(0, labels, n), which)
    return [(i * 4, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, given))]


def clean(rows, long=2**63):
    """{id: (label, whole components)} as the docstring defines it."""
    kept = {}
    for key, vector, label in rows:
        if None in (key, vector, label) or any(x is None or not np.isfinite(x) for x in vector):
            continue
        own = (label, [float(np.float32(x)) for x in vector])
        kept[key] = min(kept.get(key, own), own)
    return {k: (label, [int(np.floor(256 * x)) for x in v]) for k, (label, v) in kept.items()}


def brute(rows, every=100, top=5):
    kept = clean(rows)
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), k, other) for k, (other, w) in kept.items() if k != a)
        for p, pk, _ in [s for s in scored if s[2] == label][:top]:
            near = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:top]
            out += [(a, pk, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(near)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)
    with Scratch(spark) as scratch:
        return sorted(tuple(r) for r in hard_negatives(scratch, df, **more).collect())


@pytest.mark.parametrize("seed,spread", [(1, 0.1), (2, 0.5), (3, 2.0)])
def test_all_pairs(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    rows = made(seed, spread=spread)
    expected = brute(rows, every=20)
    assert len(expected) > 20
    assert found(spark, rows, every=20) == expected


def test_awkward_rows(spark):
    rows = made(4, n=300)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 20, 1), (1, None, 1), (2, [0.5] * 20, None), (5, [None, 1.0], 0), (6, [nan] * 20, 1), (7, [inf], 2), (9, [-inf], 2)]
    # No components, fewer, more; ties; rows of one id, alike and not.
    rows += [(2000, [], 1), (2100, [0.3] * 7, 0), (2200, [0.2] * 37, 1), (2201, [0.2] * 37, 0), (2202, [0.2] * 37, 0), (2203, [0.2] * 37, 1)]
    rows += [rows[0], rows[0], (400, [0.5] * 20, 2), (400, [0.5] * 20, 2), (2204, [0.2] * 37, 5), (2204, [-0.2] * 37, 1)]
    # All zero, negative ids, negative products.
    rows += [(2300, [0.0] * 20, 0), (-100, [0.4] * 20, 0), (2400, [-0.4] * 20, 9), (2401, [0.4] * 20, 9), (-3, [0.3] * 20, 1)]
    expected = brute(rows)
    assert {r[0] for r in expected} >= {0, 400, 2200, -100}
    assert found(spark, rows) == expected


def test_products_beyond_exact_doubles_and_longs(spark):
    rng = random.Random(5)
    for size in (2.0**22, 2.0**40, 1e30):
        rows = [(100 * i if i < 3 else 7 * i + 1, [rng.uniform(0.5, 1) * size for _ in range(5)], i % 2) for i in range(40)]
        assert found(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 0)]) == []
    assert found(spark, [(100, None, 0)]) == []


def test_one_label_and_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    rows = [(i, [0.1, 0.2], 0) for i in range(400)]
    assert found(spark, rows) == []
    rows = [(i, [0.1, 0.2], int(i % 3 == 0)) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 48))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.05 * rng.normal(size=(3000, 48))
    rows = Block.of(dict(zip(negatives._NAMES, Block.make(list(range(3000)), [0] * 3000, list(vectors), 48).row())))
    anchors = Block.make(list(range(9)), [1] * 9, list(vectors[:9]), 48)
    every = scores(anchors, rows, np.arange(3000))
    low = np.partition(every, -40, axis=1)[:, -40]
    at = candidates(anchors, rows, low, every.max(axis=1), np.ones((9, 3000), bool))
    assert set(np.flatnonzero((every >= low[:, None]).any(axis=0))) <= set(at)
    assert len(at) < 2500


def test_labels_move_on(spark):
    df = spark.createDataFrame([(0, 9), (7, 3), (8, 3), (14, None), (None, 2)], "vec_id long, label int")
    assert [r["label"] for r in shifted(df).collect()] == [0, 4, 3, None, 2]
