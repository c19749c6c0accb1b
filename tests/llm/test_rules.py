import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_data import awkward, table
from syntabula.llm import rules
from syntabula.llm.common import Scratch

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def base(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def rows():
    out = [(*r, "en", "s") for r in awkward(5)]
    return out + [(700, "a b c a b c a b c d", None, "s"), (701, "x\n\nx\n x\nx", "fr", "s"), (702, "# * | <>\r\v\f$% " * 30, "de", "s")]


def test_base_counts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with Scratch(spark) as scratch:
        found = rules.controlled(scratch, table(spark, rows()), labels).collect()
    got = sorted(((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in found), key=str)
    assert got == sorted(((k, *base(t)) for k, t, *_ in rows()), key=str)
    # Without labels the base rules alone decide.
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


@pytest.mark.parametrize("n, k, p", [(1, 0, 0.5), (10, 3, 0.2), (500, 0, 0.01), (2000, 5, 0.01), (100_000, 900, 0.01), (40, 40, 0.3)])
def test_binomial(spark, n, k, p):
    got = spark.range(1).select(rules.binomial_cdf(F.lit(k), F.lit(n), p)).first()[0]
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    assert got == pytest.approx(min(1.0, sum(term(i) for i in range(k + 1))), rel=1e-8)


def test_cutoffs_keep_their_promise(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(6000):
        good = i % 3 > 0
        words = [f"word{rng.randrange(10**6)}" for _ in range(60)]
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "aa" if i % 2 else "bb", "s"))
        if i % 5 or i % 2:
            labels.append((i, int(good), 0))
    # Too few labels: no cutoff, nothing but base rules.
    docs += [(10_000 + i, " ".join(f"w{j}%%%%" for j in range(60)), "cc", "s") for i in range(5)]
    labels += [(10_000, 1, 0), (10_000, None, None), (None, 1, 1)]
    with Scratch(spark) as scratch:
        found = rules.controlled(scratch, table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i in range(6000) if i % 3) and not any(kept[i] for i in range(0, 6000, 3))
    assert all(kept[10_000 + i] for i in range(5))


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with Scratch(spark) as scratch:
        assert rules.controlled(scratch, table(spark, []), labels).count() == 0
