import random

import numpy as np
import pytest
import xxhash

from llm_data import awkward, table
from syntabula.llm.common import Scratch
from syntabula.llm.graph import components
from syntabula.llm import hamming
from syntabula.llm import simhash
from syntabula.llm.simhash import BITS, anchors, near_duplicates, similar_documents


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= BITS:
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, fps[i], least.get(root(i))) for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    rows = awkward(1)
    with Scratch(spark) as scratch:
        found = near_duplicates(scratch, table(spark, rows))
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_every_near_pair_shares_an_anchor():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(0, BITS + 1), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    for x, y in zip(base, other):
        a, b = (set(anchors(np.array([v]))[1].tolist()) for v in (x, y))
        assert a & b


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r["node"]: r["label"] for r in components(scratch, links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty_table(spark):
    with Scratch(spark) as scratch:
        assert near_duplicates(scratch, table(spark, [])).count() == 0


def test_similar_documents(spark, monkeypatch):
    """Near copies are found through each other, copies share a component, others stay apart."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(25):
        base = say(rng.randint(80, 300))
        for k in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(max(1, len(own) // 120) if k else 0):
                own[rng.randrange(len(own))] = "edited"
            rows.append((len(rows), " ".join(own)))
            groups.setdefault(g, []).append(len(rows) - 1)
        rows.append((len(rows), rows[-1][1]))
        groups[g].append(len(rows) - 1)
    for block in (4096, 3):
        monkeypatch.setattr(hamming, "BLOCK", block)
        with Scratch(spark) as scratch:
            found = {r["doc_id"]: r["component_id"] for r in similar_documents(scratch, table(spark, rows)).collect()}
        assert len(found) == len(rows)
        # No component joins two groups; most near copies are with their group.
        of = {i: g for g, own in groups.items() for i in own}
        assert all(of[i] == of[c] for i, c in found.items())
        assert sum(found[i] == own[0] for own in groups.values() for i in own) >= 0.9 * len(rows)


def test_similar_documents_awkward(spark):
    rows = awkward(8)
    with Scratch(spark) as scratch:
        found = similar_documents(scratch, table(spark, rows)).collect()
        assert len(found) == len(rows)
        assert similar_documents(scratch, table(spark, [])).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert by[100] == by[101] == by[102] == 100 and by[3] == by[3]


def shingles(text, size=5):
    words = text.lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_similar_documents_at_the_bound(spark, monkeypatch):
    """Pairs just above similarity 0.8 are linked, pairs just below are not; chains as by all pairs."""
    rng = random.Random(5)
    rows = []
    for g in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        rows.append((len(rows), " ".join(base)))
        # The tail is new, so the similarity is that of the lengths.
        for wanted in rng.sample([0.6, 0.7, 0.75, 0.79, 0.81, 0.83, 0.9], rng.randint(1, 3)):
            own = round(2 * wanted / (1 + wanted) * len(base))
            rows.append((len(rows), " ".join(base[:own] + [f"n{rng.randrange(10**6)}" for _ in range(len(base) - own)])))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    near = 0
    for i in range(len(rows)):
        for j in range(max(0, i - 4), i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert near > 60
    for block in (4096, 3):
        monkeypatch.setattr(hamming, "BLOCK", block)
        with Scratch(spark) as scratch:
            found = {r["doc_id"]: r["component_id"] for r in similar_documents(scratch, table(spark, rows)).collect()}
        assert found == {i: root(i) for i in range(len(rows))}


def test_fingerprints_link_documents(spark, monkeypatch):
    """Without keys of least hashes, anchors alone bring near copies together; the exact check still decides."""
    monkeypatch.setattr(simhash, "_ANY", -1)
    base = [f"w{i}" for i in range(400)]
    # One text has all its shingles twice, so the fingerprint is the same but not the set.
    texts = [base, [*base[:-1], "end"], [f"v{i}" for i in range(400)], base + base, [*base[:200], *(f"n{i}" for i in range(200))]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    near = (fingerprint(rows[0][1], 5) ^ fingerprint(rows[1][1], 5)).bit_count()
    assert near <= BITS
    with Scratch(spark) as scratch:
        found = {r["doc_id"]: r["component_id"] for r in similar_documents(scratch, table(spark, rows)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_anchor_pairs_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(b)) for b in (0, 9, 40))])
    # Two names per fingerprint.
    rows = [(int(f), 2 * i + k) for i, f in enumerate(fps.view(np.int64)) for k in (0, 1)]
    with Scratch(spark) as scratch:
        pairs = simhash.anchor_pairs(scratch, spark.createDataFrame(rows, "fp long, id long"))
        found = {r["node"]: r["label"] for r in components(scratch, pairs).collect()}
    assert found == {2 * i + k: 2 * (i % 40) for i in range(len(fps)) for k in (0, 1)}
