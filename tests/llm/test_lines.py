import re

import pytest

from llm_data import table
from syntabula.llm import hamming, lines
from syntabula.llm.common import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents():
    import random

    rng = random.Random(11)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 80))) for _ in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                line = line.replace(rng.choice(WORDS), rng.choice(WORDS), 1)
            own.append(rng.choice([line, line.upper(), f" {line}  ", f"{line} {rng.randrange(10)}"]))
        rows.append((i, "\n".join(own)))
    long = "\n".join(f"{a} {b} {c}" for a in WORDS for b in WORDS for c in WORDS[:5])
    return rows + [(90, None), (91, ""), (92, "\n\n \n"), (93, long), (3, rows[3][1]), (None, rows[5][1]), (None, "only here"), (5, "only here")]


def normal(line):
    return re.sub(r"[ \t\n\v\f\r]+", " ", line.lower()).strip(" ")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def blocks_of(texts):
    """(fingerprint, keys) of each normalised line."""
    words, counts = lines._words([t.encode() for t in texts])
    keys = [set() for _ in texts]
    for i, key in zip(*lines.line_blocks(words, counts)):
        keys[i].add(int(key))
    return [int(f) for f in lines.line_fingerprints(words, counts)], keys


def brute(rows):
    """Group of each distinct line, by all pairs."""
    known = sorted({normal(x) for _, t in rows if t for x in t.split("\n")} - {""})
    fps, keys = blocks_of(known)
    group = list(range(len(known)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            if keys[i] & keys[j] and (fps[i] ^ fps[j]).bit_count() <= lines.BITS:
                most = max(len(known[i]), len(known[j]))
                if levenshtein(known[i], known[j]) <= int((1 - lines.SIMILARITY) * most + 1e-9):
                    group[root(i)] = root(j)
    at = {line: root(i) for i, line in enumerate(known)}
    return at


def kept_text(rows, at, hashes):
    """First occurrence of each group by (null id, id, text hash, place)."""
    first = {}
    for (key, text), h in zip(rows, hashes):
        for k, line in enumerate((text or "").split("\n")):
            if n := normal(line):
                where = (key is None, key or 0, h, k)
                first[at[n]] = min(first.get(at[n], where), where)
    out = []
    for (key, text), h in zip(rows, hashes):
        own = [
            line for k, line in enumerate((text or "").split("\n"))
            if not (n := normal(line)) or first[at[n]] == (key is None, key or 0, h, k)
        ]
        out.append((key, None if text is None else "\n".join(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, broadcast", [(4096, 200_000), (2, 0)])
def test_equals_all_pairs(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(hamming, "BLOCK", block)
    monkeypatch.setattr(hamming, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", broadcast)
    rows = documents()
    hashes = [r[0] for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, t string").orderBy("i").selectExpr("xxhash64(coalesce(t, ''))").collect()]
    with Scratch(spark) as scratch:
        found = lines.deduplicated(scratch, table(spark, rows))
    got = found.collect()
    assert set(found.columns) == {*table(spark, []).columns, "n_lines", "n_removed"}
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == kept_text(rows, brute(rows), hashes)
    assert sum(r["n_removed"] for r in got) > 20


def test_empty_table(spark):
    with Scratch(spark) as scratch:
        assert lines.deduplicated(scratch, table(spark, [])).count() == 0


def test_rows_of_numbers_are_verified_with_their_digits(spark):
    rows = [(0, "1234 56\n2026-01-02 17.50"), (1, "9871 23\n1999-12-31 82.64"), (2, "Page 17 of the report\nonly"), (3, "page 18 of  the report\n1234 57")]
    with Scratch(spark) as scratch:
        found = {r["doc_id"]: r["text"] for r in lines.deduplicated(scratch, table(spark, rows)).collect()}
    assert found == {0: rows[0][1], 1: rows[1][1], 2: rows[2][1], 3: ""}


def replaced(rng, words, changes):
    """Pairs of lines of so many made words, so many of them replaced, at edit similarity 0.8 or more."""
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    vocabulary = [made() for _ in range(2000)]
    out = []
    while len(out) < 150:
        old = rng.choices(vocabulary, k=words)
        new = list(old)
        for i in rng.sample(range(words), changes):
            new[i] = rng.choice(vocabulary)
        a, b = " ".join(old), " ".join(new)
        if a != b and levenshtein(a, b) <= (1 - lines.SIMILARITY) * max(len(a), len(b)) + 1e-9:
            out.append((a, b))
    return out


@pytest.mark.parametrize("words, changes, least", [(5, 1, 0.9), (8, 1, 0.95), (12, 1, 1), (20, 1, 1), (20, 2, 0.9), (27, 1, 1), (40, 1, 1), (40, 2, 0.95)])
def test_recall_by_edit_similarity_alone(words, changes, least):
    import random

    pairs = replaced(random.Random(words), words, changes)
    (fa, ka), (fb, kb) = (blocks_of(side) for side in zip(*pairs))
    met = [bool(x & y) and (f ^ g).bit_count() <= lines.BITS for f, g, x, y in zip(fa, fb, ka, kb)]
    assert sum(met) >= least * len(met)


def test_lines_of_one_shape_are_no_hot_group(spark):
    import random

    rng = random.Random(5)
    shape = [(i, "\n".join(f"{rng.randrange(10**6):06} {rng.randrange(10**6):06} {rng.randrange(10**6):06}" for _ in range(100))) for i in range(200)]
    with Scratch(spark) as scratch:
        found = {r["doc_id"]: r["text"] for r in lines.deduplicated(scratch, table(spark, shape)).collect()}
    # Chance neighbours only: a line goes if another is within a fifth of its characters.
    assert sum(len(found[i].split("\n")) == 100 for i, _ in shape) > 190


def test_lines_of_one_common_word_are_not_listed_in_pairs(spark, monkeypatch):
    import random

    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # Two words, one of them common: blocks of all lines, of which two are near.
    known = [f"thecommonword {made(9)}" for _ in range(400)] + ["thecommonword abcdefghi", "thecommonword abcdefghj"]
    written, table_of = [], Scratch.table

    def counted(self, df, keep=False):
        out = table_of(self, df, keep)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    with Scratch(spark) as scratch:
        found = {r["doc_id"]: r["text"] for r in lines.deduplicated(scratch, table(spark, list(enumerate(known)))).collect()}
    at = brute(list(enumerate(known)))
    assert sum(t == "" for t in found.values()) == len(at) - len(set(at.values())) > 0
    # At most a forest of each of the ten blocks of a line; all pairs would be a fifth of 402 * 401.
    assert 0 < max(written) <= 10 * len(known)


def test_texts_go_packed_to_the_range_of_their_hash():
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import xxhash

    texts = [f"number {i} é" for i in range(500)] + ["number 7 é"]
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 90]), pa.array(texts[k : k + 90])], names=["line_hash", "normal"]) for k in range(0, 501, 90)]
    parts = pa.Table.from_batches([b for one in batches for b in lines._text_parts(6)(iter([one]))]).to_pandas()
    asked, found = pd.DataFrame({"id": hashes[::3], "range": hashes[::3].view(np.uint64) >> np.uint64(58)}), []
    for name, part in parts.groupby("range"):
        found.append(lines._asked(part, asked[asked["range"] == name]))
    found = pd.concat(found)
    assert sorted(found["id"]) == sorted(set(hashes[::3].tolist()))
    assert {i: (t, n) for i, t, n in zip(found["id"], found["normal"], found["size"])} == {h: (t, len(t)) for h, t in zip(hashes[::3].tolist(), texts[::3])}
    assert found["fp"].tolist() == [np.int64(np.uint64(f).view(np.int64)) for f in lines.line_fingerprints(*lines._words([t.encode() for t in found["normal"]]))]


def test_a_text_is_split_once_for_all_kept_lines(spark):
    rows = [(0, "\n".join(f"{i} own{i} words{i * 7}" for i in range(300)) + "\nthe same line here"), (1, "the same line here\nonly this is left")]
    with Scratch(spark) as scratch:
        found = lines.deduplicated(scratch, table(spark, rows))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in found.collect()}[1] == (2, 1)
