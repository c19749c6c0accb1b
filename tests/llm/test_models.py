"""Quality and toxicity: held-out accuracy and awkward rows."""

import random
import zlib

import numpy as np
import pytest

from llm_data import awkward, table
from syntabula.llm import quality, toxicity

SYLLABLES = "an be co du el fi go hu in ja ka lo mi nu or pa qui ro su te".split()


def documents(seed, n=700):
    """(doc_id, text, quality, toxic): poor texts have signs at their words, toxic ones insults, some in disguise."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    insults = ["grumblefok", "snarzle", "plimkonk"]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic, good = int(i % 4 == 0), int(i % 5 > 0)
        for _ in range(3 * toxic):
            w = rng.choice(insults)
            p = rng.randrange(1, len(w))
            words.insert(rng.randrange(len(words)), rng.choice([w, w, w.upper(), f"{w[:p]}.{w[p:]}", " ".join(w), f"{w[:p]}x{w[p:]}"]))
        if not good:
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        out.append((i, " ".join(words), good, toxic))
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    made = documents(1)
    docs = table(spark, [(i, t) for i, t, _, _ in made] + [(10_000, ""), (10_001, None), (None, "grumblefok snarzle")])
    given = labels(spark, [(i, q, x) for i, _, q, x in made] + [(None, 1, 1), (5, None, None)])
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, given).collect()}
    truth = {i: x for i, _, _, x in made}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in truth) and got[None]["held_out"] is False
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[10_000]["score"] == got[10_001]["score"] < 0.5


def test_scores_do_not_depend_on_the_cap_of_a_class(spark, monkeypatch):
    """Of the documents with insults four in ten are toxic: their scores say so, also if the sample has as many of each class."""
    rng = random.Random(4)
    made = [(i, t, q, int(x and rng.random() < 0.4)) for i, t, q, x in documents(4, 1500)]
    docs, given = table(spark, [(i, t) for i, t, _, _ in made]), labels(spark, [(i, q, x) for i, _, q, x in made])
    for most in (1500, 110):
        monkeypatch.setattr(toxicity, "MOST_DOCS", most)
        insulting = [r["score"] for r in toxicity.toxicity(docs, given).collect() if r["doc_id"] % 4 == 0]
        assert np.mean(insulting) == pytest.approx(0.4, abs=0.2)


def test_held_out_labels_are_not_used(spark):
    made = documents(2, 200)
    docs = table(spark, [(i, t) for i, t, _, _ in made])
    flip = lambda i, x: 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x
    a = toxicity.toxicity(docs, labels(spark, [(i, q, x) for i, _, q, x in made])).collect()
    b = toxicity.toxicity(docs, labels(spark, [(i, q, flip(i, x)) for i, _, q, x in made])).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_kernel_equals_its_definition():
    alphabet = toxicity._alphabet()
    units = toxicity.Units(["abcd abxcd zz a", "abcde"], alphabet)

    def vector(i):
        c = units.codes[units.at[i] : units.at[i] + units.size[i] + 2].tolist()
        out = {}
        for p in range(len(c)):
            for a, b, d in toxicity.OFFSETS:
                if p + d < len(c):
                    key = (c[p], c[p + a], c[p + b], c[p + d])
                    out[key] = out.get(key, 0) + toxicity.DECAY**d
        return out

    vectors, norms = [vector(i) for i in range(len(units.size))], units.norms()
    want = [[sum(v * y.get(k, 0) for k, v in x.items()) / n / m for y, m in zip(vectors, norms)] for x, n in zip(vectors, norms)]
    assert toxicity.kernel(units, units) == pytest.approx(np.array(want), abs=1e-5)


def test_words_are_read_through_disguise():
    alphabet = toxicity._alphabet()
    same = [toxicity.Units([t], alphabet).names().tolist() for t in ("idiot", "I.D.I.O.T", "i d i o t", "1di0t", "id-iot")]
    assert all(s == same[0] for s in same) and len(toxicity.Units(["", " . "], alphabet).size) == 0


def test_no_labels_no_rows(spark):
    empty = labels(spark, [])
    found = toxicity.toxicity(table(spark, awkward(1)), empty).collect()
    assert len(found) == len(awkward(1)) and not any(r["predicted"] for r in found)
    assert toxicity.toxicity(table(spark, []), empty).count() == 0


def test_quality_held_out(spark):
    made = documents(3)
    docs = table(spark, [(i, t) for i, t, _, _ in made] + awkward(2)[-12:])
    given = labels(spark, [(i, q, x) for i, _, q, x in made if i % 3] + [(None, 1, 1), (4, None, None), (1, 1, 0)])
    ratings = given.select("doc_id", quality.grade_of(given).alias("grade"))
    model = quality.train(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.graded(docs, model).collect()
    held = {i: q for i, _, q, _ in made if i % 3 == 0}
    assert np.mean([r["kept"] == bool(held[r["doc_id"]]) for r in got if r["doc_id"] in held and r["doc_id"] < 99]) > 0.97
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_without_ratings(spark):
    given = labels(spark, [])
    model = quality.train(table(spark, awkward(1)), given.select("doc_id", quality.grade_of(given).alias("grade")), 3)
    assert all(r["kept"] for r in quality.graded(table(spark, awkward(1)), model).collect())
    assert quality.graded(table(spark, []), model).count() == 0


def test_gradient_of_the_ordinal_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    grade = np.digitize(x @ np.array([2.0, -1.0]) + rng.logistic(size=600), [-1.0, 1.5])
    model = quality.fit([(np.array([0, 1]), v, int(g)) for v, g in zip(x, grade)], 3, steps=600, ridge=0)
    assert model.weights[:2] == pytest.approx([2.0, -1.0], abs=0.4) and model.thresholds == pytest.approx([-1.0, 1.5], abs=0.4)
