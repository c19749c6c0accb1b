import random
import re

from llm_data import table
from syntabula.llm import decontamination as D
from test_edit import table as distances

WORDS = "of the and to in is was that for on are as with his they at be this from".split()


def fixture():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.randint(5, 40))) for i in range(12)] + [(50, "too short"), (53, "is"), (54, " The  AND"), (55, "x"), (56, "2 + 2 = 4"), (51, None), (52, ""), (None, say(20)), (0, say(12))]
    rows = []
    for i in range(60):
        text = say(rng.randint(0, 50))
        if i % 3 == 0:
            item = list(rng.choice([t for _, t in items if t]))
            for _ in range(rng.randint(0, 8)):
                p = rng.randrange(len(item))
                item[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "q "])
            text = f"{text} {''.join(item).upper() if i % 2 else ''.join(item)}\n{say(10)}"
        rows.append((i, text))
    return items, [*rows, (83, "It is too short."), (84, "too shorts"), (85, "so 2 + 2 = 4!"), (86, "12 + 2 = 4 2 + 2 = 42"), (87, "the and"), (80, None), (81, ""), (82, say(8000)), (None, items[2][1]), (7, rows[7][1]), (7, rows[7][1])]


def brute(items, rows):
    out = []
    for key, text in rows:
        for item, want in items:
            want, have = D.normal(want), D.normal(text)
            if want and have and len(want) < D.LEAST_CHARS:
                # Plain words: no letter or digit right before or after.
                if re.search(rf"(?<![0-9a-zäé]){re.escape(want)}(?![0-9a-zäé])", have):
                    out.append((key, item, 0))
            elif len(want) >= D.LEAST_CHARS and have:
                last = distances(want, have, True)
                if min(last) <= int(len(want) * D.ERROR_RATE):
                    out.append((key, item, min(last)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    items, rows = fixture()
    rows_small = [r for r in rows if len(r[1] or "") < 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_CHARS, 150):
        monkeypatch.setattr(D, "BLOCK_CHARS", block)
        got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(table(spark, rows_small), bench).collect()), key=str)
        assert got == brute(items, rows_small) and got
    hit = {(k, t) for k, t in rows_small if any(k == g[0] for g in got)}
    kept = D.decontaminated(table(spark, rows), bench)
    assert kept.columns == table(spark, []).columns
    left = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert not left & hit and {r for r in rows_small if r not in hit} <= left


def test_empty_tables(spark):
    items, rows = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(table(spark, []), bench).count() == 0
    assert D.contaminated(table(spark, rows[:3]), bench.limit(0)).count() == 0
    assert D.decontaminated(table(spark, rows[:3]), bench.limit(0)).count() == 3


def test_short_items_of_every_length(spark):
    """Items of 1 to 19 characters: found as whole words, not inside longer ones."""
    rng = random.Random(10)
    items = [(n, "".join(rng.choice("abcdefgh") for _ in range(n))) for n in range(1, 20)]
    rows = [(n, f"zz {t.upper()}, zz") for n, t in items] + [(100 + n, f"zz q{t} {t}7 zz") for n, t in items]
    got = D.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(n, n, 0) for n in range(1, 20)]


def test_short_items_in_scripts_without_spaces():
    found = D.Matcher([(1, "東京都"), (2, "kyoto")], D.ERROR_RATE).find("これは東京都です。kyotois kyoto東")
    assert [(f[0], f[3]) for f in found] == [(1, 6), (2, 22)]
