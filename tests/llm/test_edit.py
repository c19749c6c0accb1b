import random

import pytest

from syntabula.llm import edit
from syntabula.llm.edit import aligned_cost, best_match, distance, within


def table(a, b, free):
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row


def test_equals_the_table():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert distance(a, b) == table(a, b, False)[-1]
        last = table(a, b, True)
        assert best_match(a, b) == ((min(last), last.index(min(last))) if a else (0, 0))


def test_within_equals_the_distance():
    rng = random.Random(6)
    for _ in range(300):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))]
        other = [w if rng.random() < 0.8 else w[::-1] + rng.choice(["", "x", " y"]) for w in words if rng.random() < 0.95]
        a, b = " ".join(words), " ".join(other)
        d = distance(a, b)
        assert aligned_cost(a, b, len(a) + len(b)) >= d
        for most in (0, d - 1, d, d + 1, 2 * d):
            assert within(a, b, most) == (d <= most)


@pytest.mark.parametrize("fewest, longest", [(1, 4096), (4, 4096), (1, 100), (10**6, 4096)])
def test_many_pairs_at_once_equal_one_by_one(monkeypatch, fewest, longest):
    monkeypatch.setattr(edit, "FEWEST", fewest)
    monkeypatch.setattr(edit, "LONGEST", longest)
    rng, pairs, most = random.Random(7), [("", ""), ("", "ab"), ("ab", "")], [0, 1, 2]
    for _ in range(900):
        size, letters = rng.choice([1, 3, 20, 63, 64, 65, 128, 150, 300]), rng.choice(["ab", "abcdefgh é€𝒳"])
        a = "".join(rng.choices(letters, k=size))
        b = list(a)
        for _ in range(rng.randint(0, size // 3 + 1)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        pairs.append((a, "".join(b)))
        most.append(rng.choice([0, 1, size // 5, size]))
    wanted = [edit.distance(a, b) <= limit for (a, b), limit in zip(pairs, most)]
    assert edit.all_within(pairs, most).tolist() == wanted
    assert 100 < sum(wanted) < 800
    assert edit.all_within([], []).tolist() == []


def test_pairs_that_are_far_apart_are_not_compared_to_their_end(monkeypatch):
    rng, read, take = random.Random(8), [], edit._Sides.take
    monkeypatch.setattr(edit._Sides, "take", lambda self, rows, side, first, stop: read.append(stop) or take(self, rows, side, first, stop))
    pairs = [tuple("".join(rng.choices("abcdefgh ", k=1500)) for _ in range(2)) for _ in range(40)]
    assert not edit.all_within(pairs, [300] * 40).any()
    assert 0 < max(read) <= 1000
    # One of them at its limit is still found, also where few are left.
    a = pairs[0][0]
    near = (a, "".join(c if i % 5 or i >= 1500 else "x" for i, c in enumerate(a)))
    assert edit.all_within([*pairs, near, near], [300] * 41 + [299]).tolist() == [False] * 40 + [True, False]


def test_distance_ends_above_its_limit(monkeypatch):
    monkeypatch.setattr(edit, "COLUMNS", 4)
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(2))
        most, whole = rng.randint(0, 40), table(a, b, False)[-1]
        found = distance(a, b, most)
        assert found == whole if whole <= most else most < found <= whole
