"""Edit distance by bit vectors, and search of long texts for near matches of short items."""

from __future__ import annotations

from collections import Counter

import numpy as np


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(pattern: str, text: str, places: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end): least edit distance of the pattern to any substring, first end that has it.

    Bit-parallel columns of the distance table: vertical differences are two bit
    vectors, so a character of the text costs a few operations on whole integers.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    places = masks(pattern) if places is None else places
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(eq | plus) & full)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _smallest(plus: int, minus: int, rows: int) -> int:
    """The smallest number of a column of so many rows, counted from the one above it."""
    up, down = (np.unpackbits(np.frombuffer(v.to_bytes(-(-rows // 8), "little"), np.uint8), count=rows, bitorder="little") for v in (plus, minus))
    return min(0, int(np.cumsum(up.astype(np.int32) - down).min()))


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance of two whole strings; what both begin and end with is left out first.

    One above most may come out smaller, but above most: all ways pass each column, so once no
    number of a column is at most so much the rest is not computed.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle :] == b[len(b) - middle :]:
            low = middle
        else:
            high = middle - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    m = len(a)
    if m == 0:
        return len(b)
    places = masks(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, c in enumerate(b, 1):
        eq = places.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(eq | plus) & full)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if most is not None and j % COLUMNS == 0 and (least := j + _smallest(plus, minus, m)) > most:
            return least
    return score


#: Words that aligned_cost() looks ahead on both sides together.
AHEAD = 16
#: Strings of this length or more are held by their grams before they are compared.
GRAM, GRAM_LENGTH = 3, 64
#: Columns after which distance() looks whether it can end.
COLUMNS = 256


def aligned_cost(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: words are matched from the left, what lies between costs its longer side.

    Ends once the cost is above most, and returns most + 1 then.
    """
    x, y = a.split(" "), b.split(" ")
    n, m, i, j, cost = len(x), len(y), 0, 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        ends = next(
            ((p, q) for s in range(1, AHEAD + 1) for p in range(i, min(i + s, n - 1) + 1) if j <= (q := j + s - (p - i)) < m and x[p] == y[q]), (n, m)
        )
        cost += max(sum(map(len, x[i : ends[0]])) + ends[0] - i, sum(map(len, y[j : ends[1]])) + ends[1] - j)
        i, j = ends
        if cost > most:
            return most + 1
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two whole strings is at most so much.

    Three bounds settle most pairs before the distance is computed: lengths, the cost of
    one alignment by words, and grams (an edit changes at most GRAM of them).
    """
    if abs(len(a) - len(b)) > most:
        return False
    if aligned_cost(a, b, most) <= most:
        return True
    if min(len(a), len(b)) >= GRAM_LENGTH:
        grams = [Counter([t[i : i + GRAM] for i in range(len(t) - GRAM + 1)]) for t in (a, b)]
        if max((grams[0] - grams[1]).total(), (grams[1] - grams[0]).total()) > GRAM * most:
            return False
    return distance(a, b, most) <= most


#: Pairs that all_within() compares at a time, the longest strings it compares in arrays, and
#: the fewest pairs of like length that are worth it.
PAIRS, LONGEST, FEWEST = 2048, 4096, 4
#: (pair, character) entries of a word, columns between two looks at which pairs are out of reach,
#: rows between the distances that are looked at.
ENTRIES, LOOK, STEP = 1 << 18, 32, 16
#: Characters of the texts of a batch, padded, and pairs that are worth a wider range of lengths.
CELLS, SMALL = 1 << 23, 512
_WORD = 64


class _Sides:
    """Sides of pairs of texts, given by their numbers, as numbers of their characters: the shorter side, the longer one."""

    def __init__(self, texts: list[str], left: np.ndarray, right: np.ndarray):
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        both = np.stack([np.where(size[left] <= size[right], left, right), np.where(size[left] <= size[right], right, left)], axis=1)
        self.size, self.at = size[both], (np.cumsum(size) - size)[both]
        seen = np.zeros(int(chars.max(initial=0)) + 1, bool)
        seen[chars] = True
        #: The number that no character has stands behind strings that are shorter than others.
        self.pad = int(np.count_nonzero(seen))
        small = np.min_scalar_type(self.pad)
        self.codes = np.full(len(chars) + 1, self.pad, small)
        self.codes[:-1] = (np.cumsum(seen) - 1).astype(small)[chars]

    def strip(self) -> None:
        """Leaves out what both sides of a pair begin and end with."""
        for end in (False, True):
            rest = np.arange(len(self.size))
            while len(rest):
                columns, short = np.arange(_WORD), self.size[rest, 0]
                left, right = ((self.at + self.size - 1 if end else self.at)[rest, side, None] + (-columns if end else columns) for side in (0, 1))
                last = len(self.codes) - 1
                same = (self.codes[np.clip(left, 0, last)] == self.codes[np.clip(right, 0, last)]) & (columns < short[:, None])
                common = np.where(same.all(axis=1), _WORD, same.argmin(axis=1))
                self.size[rest] -= common[:, None]
                if not end:
                    self.at[rest] += common[:, None]
                rest = rest[common == _WORD]

    def take(self, rows: np.ndarray, side: int, first: int, stop: int) -> np.ndarray:
        """The characters first:stop of one side of the pairs, a column each, padded."""
        place = np.arange(first, stop)[:, None]
        index = np.where(place < self.size[rows, side], self.at[rows, side] + place, len(self.codes) - 1)
        return self.codes[index].astype(np.int64)


def _banded(sides: _Sides, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of these pairs is at most so much.

    Both sides get the same padding, so that all texts are equally long, which leaves the
    distance. A column of a distance table is a row of 64-bit words of vertical differences;
    word w of a column needs word w - 1 of the same one, so the words of a slanted line are
    computed at once, for all pairs. A path of cost most leaves the diagonals between both
    corners by half of what it has left at most; only words within these change: above
    them the distance is taken to grow by one a column, below them by one a row. Both are
    upper bounds, and no path of cost most or less leaves the band.

    Every path crosses the slanted line. So a pair goes as soon as all distances there are
    above most; every STEP-th is looked at, and neighbours differ by one at most.
    """
    out, size = np.zeros(len(rows), bool), sides.size[rows]
    n, extra = int(size[:, 1].max()), size[:, 1] - size[:, 0]
    m = n - extra
    words = -(-int(m.max()) // _WORD)
    under, over = int(((most - extra) // 2).max()), int(((most + extra) // 2).max())
    own = np.arange(len(rows)) * (sides.pad + 1)
    places = np.zeros((words, len(rows) * (sides.pad + 1)), np.uint64)
    left, text, known, begun = np.arange(len(rows)), np.empty((n, len(rows)), np.int64), 0, 0
    plus, minus = np.full((words, len(rows)), ~np.uint64(0)), np.zeros((words, len(rows)), np.uint64)
    # What the word above leaves for each word: whether the distance there grew or fell.
    grew, fell = np.ones((words + 1, len(rows)), np.uint64), np.zeros((words + 1, len(rows)), np.uint64)
    one, top = np.uint64(1), np.uint64(_WORD - 1)
    for t in range(n + words - 1):
        low = max(0, t - n + 1, -(-(t - over - _WORD) // (_WORD + 1)))
        high = min(words - 1, t, (t + under) // (_WORD + 1))
        if low > high:
            continue
        if t - low >= known:
            stop = min(n, known + _WORD)
            text[known:stop] = sides.take(rows, 1, known, stop) + own
            known = stop
        while begun <= high:
            held = places[begun]
            for i, codes in enumerate(sides.take(rows, 0, begun * _WORD, (begun + 1) * _WORD)):
                held[own + codes] |= one << np.uint64(i)
            begun += 1
        now = slice(low, high + 1)
        p, q, up, down = plus[now], minus[now], grew[now], fell[now]
        eq = np.empty(p.shape, np.uint64)
        for w in range(low, high + 1):
            places[w].take(text[t - w], out=eq[w - low], mode="clip")
        vertical = eq | q
        eq |= down
        rise = eq & p
        rise += p
        rise ^= p
        eq |= rise
        np.bitwise_or(eq, p, out=rise)
        np.invert(rise, out=rise)
        rise |= q
        fall = eq
        fall &= p
        above, below = rise >> top, fall >> top
        rise <<= one
        rise |= up
        fall <<= one
        fall |= down
        np.bitwise_and(rise, vertical, out=q)
        vertical |= rise
        np.invert(vertical, out=vertical)
        np.bitwise_or(fall, vertical, out=p)
        grew[low + 1 : high + 2], fell[low + 1 : high + 2] = above, below
        grew[low], fell[low] = 1, 0
        if t % LOOK == LOOK - 1:
            near = _least(plus[: high + 1], minus[: high + 1], grew, fell, low, t - low + 1) <= most[left]
            if not near.any():
                return out
            if np.count_nonzero(near) < 0.75 * len(near):
                left, rows, own = left[near], rows[near], own[near]
                plus, minus, grew, fell = (x[:, near] for x in (plus, minus, grew, fell))
                held, text = text[:known, near], np.empty((n, len(left)), np.int64)
                text[:known] = held
    inside = np.clip(m[left][None, :] - np.arange(words)[:, None] * _WORD, 0, _WORD)
    mask = np.where(inside > 0, ~np.uint64(0) >> (_WORD - np.maximum(inside, 1)).astype(np.uint64), np.uint64(0))
    out[left] = n + _steps(plus & mask, minus & mask).sum(axis=0) <= most[left]
    return out


def _steps(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    return np.bitwise_count(plus).astype(np.int64) - np.bitwise_count(minus)


def _least(plus: np.ndarray, minus: np.ndarray, grew: np.ndarray, fell: np.ndarray, low: int, columns: int) -> np.ndarray:
    """A lower bound of the distances on the slanted line of the words from low on, the first of which is after so many columns."""
    total = _steps(plus, minus)
    # A word is one column behind the one above it.
    total[low + 1 :] -= (grew[low + 1 : len(total)] - fell[low + 1 : len(total)]).view(np.int64)
    ends = columns + np.cumsum(total, axis=0)[low:]
    least = ends.min(axis=0)
    for k in range(STEP, _WORD + 1, STEP):
        # What lies below the row: a shift by all bits is none.
        below = _steps(plus[low:] >> np.uint64(_WORD - k), minus[low:] >> np.uint64(_WORD - k))
        least = np.minimum(least, (ends - below).min(axis=0))
    return least - STEP // 2 - 1


def all_within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """within() of each pair."""
    places = np.arange(2 * len(pairs))
    return near_texts([s for pair in pairs for s in pair], places[::2], places[1::2], np.array(most, np.int64))


def near_texts(texts: list[str], left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """within() of pairs of texts, by their numbers; those of up to LONGEST characters are compared in arrays, many of like length at a time."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    longer = np.maximum(size[left], size[right])
    out = np.zeros(len(left), bool)
    for i in np.flatnonzero(longer > LONGEST):
        out[i] = within(texts[left[i]], texts[right[i]], int(most[i]))
    which = np.flatnonzero((longer <= LONGEST) & (np.abs(size[left] - size[right]) <= most))
    if not len(which):
        return out
    sides, limits = _Sides(texts, left[which], right[which]), most[which]
    sides.strip()
    out[which] = sides.size[:, 1] <= limits
    rest = np.flatnonzero(sides.size[:, 1] > limits)
    order, at = rest[np.argsort(-sides.size[rest, 1], kind="stable")], 0
    sizes, fit = sides.size[order, 1], max(FEWEST, min(PAIRS, ENTRIES // (sides.pad + 1)))
    while at < len(order):
        # Of like length; few pairs, whose columns cost the same, also of less like length.
        held = sizes[at : at + max(FEWEST, min(fit, CELLS // int(sizes[at])))]
        alike = max(int(np.count_nonzero(4 * held >= 3 * held[0])), int(np.count_nonzero(2 * held[:SMALL] >= held[0])))
        some = order[at : at + alike]
        if len(some) < FEWEST:
            out[which[some]] = [within(texts[left[i]], texts[right[i]], int(most[i])) for i in which[some]]
        else:
            out[which[some]] = _banded(sides, some, limits[some])
        at += len(some)
    return out
