"""Toxic documents by a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mixed

#: Training: labelled documents of each class, characters of a training document, words
#: of clean documents, landmarks, rounds of choosing the words that make a document toxic.
MOST_DOCS, MOST_CHARS, MOST_WORDS, MOST_HARD, LANDMARKS, ROUNDS = 1500, 20_000, 10_000, 3_000, 512, 3
#: A run of characters tells of insults if so many toxic documents hold it, this much more
#: often (natural logarithm of the ratio) than clean documents do, and with so small a
#: chance (negative natural logarithm) if classes didn't matter.
LEAST_DOCS, LEAST_ODDS, LEAST_SURPRISE = 5, 1.5, 12.0
#: Clean documents from which on a word is judged by itself and not by its runs.
LEAST_CLEAN = 10
FOLDS = 5
#: Kernel: four characters in order, the last at most SPAN + 1 places after the first;
#: each place costs a factor DECAY.
SPAN, DECAY = 4, 0.7
BOUND, FIRST, LAST_CODE, OTHER = 1, 62, 63, 28
#: Look-alikes of letters.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
OFFSETS = [(a, b, c) for a in range(1, SPAN) for b in range(a + 1, SPAN + 1) for c in range(b + 1, SPAN + 2)]
#: Subsequences are told apart by 22 bits of a hash.
HASH_BITS = 22
CODES = 1 << HASH_BITS
CHUNK_CHARS = 1_000_000


def _alphabet() -> np.ndarray:
    """Code of each character: 0 dropped, BOUND white space, 2-27 letters, others by rule."""
    table = np.zeros(65_536, np.int64)
    for point in range(65_536):
        c = chr(point)
        c = ALIKE.get(c, c)
        if c.isspace():
            table[point] = BOUND
        elif "a" <= c <= "z":
            table[point] = 2 + ord(c) - ord("a")
        elif c.isdigit():
            table[point] = OTHER
        elif c.isalpha():
            table[point] = OTHER + 1 + point % 33
    table[65_535] = OTHER
    return table


class Units:
    """Words of texts as codes between marks: case folded, look-alikes read as letters,
    punctuation inside a word left out, single letters in a row joined to one word."""

    def __init__(self, texts: list[str], table: np.ndarray):
        points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = table[np.minimum(points, 65_535)]
        # A text's words: lower() may change lengths, so texts are measured after it.
        sizes = np.array([len(t.lower()) + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(codes)]
        use = codes > 0
        codes, owner = codes[use], owner[use]
        solid = codes != BOUND
        edges = np.flatnonzero(np.diff(np.r_[False, solid, False].astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        size = end - begin
        doc = owner[begin] if len(begin) else np.empty(0, np.int64)
        joined = np.zeros(len(begin), bool)
        joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (doc[1:] == doc[:-1])
        word = np.cumsum(~joined) - 1
        self.doc = doc[~joined]
        count = int(word[-1]) + 1 if len(word) else 0
        self.size = np.bincount(word, size, count).astype(np.int64) if count else np.empty(0, np.int64)
        self.at = np.cumsum(self.size + 2) - self.size - 2
        self.codes = np.zeros(int(self.size.sum()) + 2 * count, np.int64)
        of = np.repeat(word, size)
        inner = np.arange(len(of)) - (np.cumsum(self.size) - self.size)[of] if count else of
        self.codes[self.at[of] + 1 + inner] = codes[solid]
        self.codes[self.at] = FIRST
        self.codes[self.at + self.size + 1] = LAST_CODE
        self.word = np.repeat(np.arange(count), self.size + 2)

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(place, code of the subsequence that starts there, weight) for each pattern of gaps."""
        letters = self.codes.astype(np.uint32)
        for a, b, c in OFFSETS:
            n = len(letters) - c
            if n > 0:
                place = np.flatnonzero(self.word[:n] == self.word[c:])
                four = (letters[place] << 18) | (letters[place + a] << 12) | (letters[place + b] << 6) | letters[place + c]
                yield place, (four * np.uint32(2654435769)) >> np.uint32(32 - HASH_BITS), DECAY**c

    def norms(self) -> np.ndarray:
        """Length of each word's feature vector if no subsequence repeats; 1 for words too short for any."""
        square = sum(DECAY ** (2 * c) * np.maximum(0, self.size + 2 - c) for _, _, c in OFFSETS)
        return np.sqrt(np.where(square > 0, square, 1))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Margin of each word: kernel sums against all landmarks at once."""
        total = np.zeros(len(self.codes))
        for place, code, weight in self.subsequences():
            total[place] += weight * weights[code]
        return np.add.reduceat(total, self.at) / self.norms() + bias if len(self.at) else np.empty(0)

    def names(self) -> np.ndarray:
        """64-bit name of each word."""
        place = np.arange(len(self.codes)) - self.at[self.word]
        letters = mixed((self.codes * 4096 + place).astype(np.uint64) + np.uint64(1))
        return mixed(np.add.reduceat(letters, self.at)) if len(self.at) else np.empty(0, np.uint64)

    def chosen(self, index: np.ndarray) -> Units:
        """The words at the index, in its order."""
        out = Units.__new__(Units)
        out.size, out.doc = self.size[index], self.doc[index]
        full = out.size + 2
        out.at = np.cumsum(full) - full
        out.word = np.repeat(np.arange(len(index)), full)
        out.codes = self.codes[np.arange(int(full.sum())) - out.at[out.word] + self.at[index][out.word]]
        return out


def joined(parts: list[Units]) -> Units:
    """The words of all parts, one after the other; doc is kept as it is."""
    out = Units.__new__(Units)
    out.codes, out.size, out.doc = (np.concatenate([getattr(p, n) for p in parts]) for n in ("codes", "size", "doc"))
    out.at = np.cumsum(out.size + 2) - out.size - 2
    out.word = np.repeat(np.arange(len(out.size)), out.size + 2)
    return out


def _features(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, value) of the normalised feature vectors."""
    parts = [(units.word[p], c, np.full(len(p), w)) for p, c, w in units.subsequences()]
    word, code, value = (np.concatenate(x) for x in zip(*parts))
    return word, code, value / units.norms()[word]


def kernel(words: Units, landmarks: Units) -> np.ndarray:
    """Normalised gap-weighted subsequence kernel between words."""
    lw, lc, lv = _features(landmarks)
    known, index = np.unique(lc, return_inverse=True)
    table = np.zeros((len(known), len(landmarks.size)), np.float32)
    np.add.at(table, (index, lw), lv)
    out = np.zeros((len(words.size), len(landmarks.size)))
    for first in range(0, len(words.size), 2000):
        w, c, v = _features(words.chosen(np.arange(first, min(first + 2000, len(words.size)))))
        at = np.minimum(np.searchsorted(known, c), len(known) - 1)
        hit = known[at] == c
        order = np.argsort(w[hit], kind="stable")
        w, at, v = w[hit][order], at[hit][order], v[hit][order]
        if len(w):
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[first + w[heads]] = np.add.reduceat(table[at] * v[:, None], heads, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge, by Newton steps over its support vectors."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-8]) * weight.sum()
    for _ in range(30):
        support = y * (x1 @ w) < 1
        a = x1[support] * weight[support][:, None]
        new = np.linalg.solve(a.T @ x1[support] + penalty, a.T @ y[support])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


#: A document's worst words that count, parts of a document, and the margin of no word.
TOP = 3
PARTS, NOTHING = TOP + 1, -1.5


class Model:
    """Word margins (weights, bias) and a logistic curve over document_parts()."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights, bias, curve

    def scores(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        units = Units(texts, table)
        margin = units.scores(self.weights, self.bias)
        parts = document_parts(units.doc, margin, np.bincount(units.doc, minlength=len(texts)))
        return 1 / (1 + np.exp(-np.clip(parts @ self.curve[:-1] + self.curve[-1], -50, 50)))


def _vocabulary(texts: list[str], table: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words; doc, word, times of each document's words; documents that are no copies).

    A document is a copy if its least hashed three words in a row, by either of two
    hashes, are those of an earlier one: hundreds of copies would make all their words
    look like insults.
    """
    parts, docs, names, counts, first_seen, alone = [], [], [], [], [set(), set()], np.zeros(len(texts), bool)
    for first in range(0, len(texts), 100):
        units = Units(texts[first : first + 100], table)
        name = units.names()
        _, index = np.unique(name, return_index=True)
        parts.append(units.chosen(index))
        pair, times = np.unique(np.stack([(units.doc + first).astype(np.uint64), name], axis=1), axis=0, return_counts=True)
        docs.append(pair[:, 0].astype(np.int64))
        names.append(pair[:, 1])
        counts.append(times)
        for i in np.unique(units.doc):
            own = name[units.doc == i]
            three = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7) if len(own) > 2 else own
            least = [int(mixed(three + np.uint64(k)).min()) for k in (0, 1)]
            alone[first + i] = all(v not in seen for v, seen in zip(least, first_seen))
            for v, seen in zip(least, first_seen):
                seen.add(v)
    every = joined(parts)
    known, index = np.unique(every.names(), return_index=True)
    return every.chosen(index), np.concatenate(docs), np.searchsorted(known, np.concatenate(names)), np.concatenate(counts), alone


def _evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Logarithm of how unlikely so many toxic documents are by chance; 0 unless far more often."""
    expected = (toxic + clean) * share + 1e-9
    surprise = toxic * np.log(np.maximum(toxic, 0.5) / expected) - (toxic - expected)
    often = toxic * (1 - share) >= np.exp(LEAST_ODDS) * share * np.maximum(clean, 0.5)
    return np.where(often & (toxic >= LEAST_DOCS), surprise, 0.0)


def _telling(words: Units, doc: np.ndarray, word: np.ndarray, label: np.ndarray, share: float, scale: float) -> np.ndarray:
    """Words with a run of four or five characters that toxic documents hold surprisingly often."""
    strong = np.zeros(len(words.size), bool)
    for k in (4, 5):
        n = len(words.codes) - k + 1
        place = np.flatnonzero(words.word[:n] == words.word[k - 1 :])
        run = np.zeros(len(place), np.uint64)
        for i in range(k):
            run = run * np.uint64(64) + words.codes[place + i].astype(np.uint64)
        of = words.word[place]
        runs, run = np.unique(run, return_inverse=True)
        # Runs of each word, then of each document.
        starts = np.searchsorted(of, np.arange(len(words.size) + 1))
        many = np.diff(starts)[word]
        pair_doc = np.repeat(doc, many)
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        pair_run = run[np.repeat(starts[word], many) + offset]
        pair = np.unique(pair_doc * len(runs) + pair_run)
        y = label[pair // len(runs)]
        held = [np.bincount((pair % len(runs))[y == v], minlength=len(runs)) for v in (1, 0)]
        good = _evidence(held[0], scale * held[1], share) >= LEAST_SURPRISE
        strong[of[good[run]]] = True
    return strong


def train(texts: list[str], toxic: list[int], seed: int = 7, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Learns which words make documents toxic from labels of whole documents.

    Words with a run of characters that toxic documents hold surprisingly often are
    positive at first; other words of clean documents are negative. Landmarks come from
    both, and the machine is trained on kernels against them; in each further round the
    words that it confuses join. Then a logistic curve over a document's three worst
    words and its length tells how many insults it takes. stands_for: labelled
    documents for which a given clean and a given toxic one stands; shares and the level of
    the curve are those of all labelled documents, not of the sample. Without both classes
    every document is called clean.
    """
    table, rng = _alphabet(), np.random.default_rng(seed)
    label = np.array(toxic)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(CODES, np.float32), -1.0, np.r_[np.zeros(PARTS), -5.0])
    words, doc, word, times, alone = _vocabulary(texts, table)
    n = len(words.size)
    once = alone[doc]
    # Clean documents count as many as there are for each toxic one of the sample.
    scale = stands_for[0] / stands_for[1]
    share = label[alone].sum() / (label[alone].sum() + scale * (1 - label[alone]).sum())
    strong = _telling(words, doc[once], word[once], label, share, scale)
    hits = np.stack([np.bincount(word[once & (label[doc] == y)], minlength=n) for y in (0, 1)], axis=1)
    # A word that many clean documents hold speaks for itself, whatever its runs say.
    usual = hits[:, 1] * (1 - share) < np.exp(LEAST_ODDS) * share * scale * hits[:, 0]
    strong &= ~((hits[:, 0] >= LEAST_CLEAN) & usual)
    weights, bias = np.zeros(CODES), -1.0
    chosen = np.flatnonzero(strong & (hits[:, 1] > 0))
    chosen = chosen[np.argsort(-hits[chosen, 1], kind="stable")][:MOST_WORDS]
    other = np.flatnonzero((hits[:, 0] > 0) & ~strong)
    clean = rng.permutation(other)[:MOST_WORDS]
    hard = clean[: LANDMARKS // 4]
    for _ in range(ROUNDS if len(chosen) and len(clean) else 0):
        negative = np.union1d(clean, hard)
        marks = np.unique(np.concatenate([chosen[: LANDMARKS // 2], hard[: LANDMARKS // 4], clean[: LANDMARKS // 4]]))
        landmarks = words.chosen(marks)
        base = kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh((base + base.T) / 2)
        use = values > 1e-3 * values.max()
        root = vectors[:, use] / np.sqrt(values[use])
        at = np.concatenate([chosen, negative])
        x = kernel(words.chosen(at), landmarks) @ root
        y = np.r_[np.ones(len(chosen)), -np.ones(len(negative))]
        # Half of the negatives' weight is on the words that are easily confused.
        near = np.isin(negative, hard)
        of = np.where(near, 0.5 / max(1, near.sum()), 0.5 / max(1, (~near).sum()))
        weight = np.r_[hits[chosen, 1] / hits[chosen, 1].sum(), of] * len(at)
        w, bias = _svm(x, y, weight)
        mw, mc, mv = _features(landmarks)
        weights = np.bincount(mc, mv * (root @ w)[mw], CODES)
        score = words.scores(weights, bias)
        hard = np.union1d(hard, other[np.argsort(-score[other], kind="stable")[:MOST_HARD]])
        hard = hard[np.argsort(-score[hard], kind="stable")]
    worst = np.repeat(np.stack([doc, word]), np.minimum(times, TOP), axis=1)
    parts = document_parts(worst[0], words.scores(weights, bias)[worst[1]], np.bincount(doc, times, len(label)))
    curve = _logistic(parts[alone], label[alone])
    # Sampling by class moves the level by the ratio of the sampled parts and nothing else.
    curve[-1] -= np.log(scale)
    return Model(weights.astype(np.float32), bias, curve)


def document_parts(doc: np.ndarray, margin: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each document: its TOP greatest margins in order (NOTHING if fewer words), log of its length."""
    out = np.full((len(n_words), PARTS), NOTHING)
    out[:, -1] = np.log1p(n_words)
    order = np.lexsort((-margin, doc))
    doc, margin = doc[order], margin[order]
    starts = np.searchsorted(doc, np.arange(len(n_words)))
    rank = np.arange(len(doc)) - starts[doc]
    top = rank < TOP
    out[doc[top], rank[top]] = np.clip(margin[top], NOTHING, 2.0)
    return out


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Coefficients and level of a logistic regression with a small ridge, by Newton steps.

    A greater margin never lowers the score: coefficients of margins stay at 0 or above.
    """
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.full(x.shape[1], 1e-2), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (label - p) - ridge * w
        # Margins held at 0 that would go below stay out of the step.
        free = ~((w <= 0) & (slope < 0)) | (np.arange(len(w)) >= TOP)
        curve = (x1[:, free] * (p * (1 - p) + 1e-9)[:, None]).T @ x1[:, free] + np.diag(ridge[free])
        w[free] += np.clip(np.linalg.solve(curve, slope[free]), -3, 3)
        w[:TOP] = np.maximum(w[:TOP], 0)
    return w


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _alphabet()
        for batch in batches:
            out = []
            held, size = [], 0
            for text in batch.column(1):
                text = text.as_py() or ""
                if held and size + len(text) > CHUNK_CHARS:
                    out.append(model.scores(held, table))
                    held, size = [], 0
                held.append(text)
                size += len(text)
            if held:
                out.append(model.scores(held, table))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out or [np.zeros(0)]))], names=["doc_id", "score"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def usable_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y): one label of each document outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most MOST_DOCS labelled rows of each class outside the held-out fold, by hash of the id."""
    usable = usable_labels(labels, label_col)
    picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCS) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = rows.where(F.length("text") <= MOST_CHARS).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    return some.select("doc_id", "text", "y")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    The model is fitted on the driver from a bounded sample of labelled rows (MOST_DOCS
    of each class, none longer than MOST_CHARS, none from the held-out fold, by order of
    a hash of the id); every whole text is then scored. A document's score is the
    calibrated probability of its worst words at the share of toxic rows among all usable
    labels, however many of them the sample holds. Null and empty texts score like a document
    whose words are far from every insult. Labels other than 0 and 1 are not used; of
    repeated labels the greatest counts; repeated documents are scored each; a null id
    is not held out. Without labels of both classes every document is clean. No rows
    give no rows; other columns are not read.
    """
    sample = sorted(training_rows(docs, labels, id_col, text_col, label_col).toLocalIterator(), key=lambda r: (r["doc_id"], r["text"]))
    n = {r["y"]: r["count"] for r in usable_labels(labels, label_col).groupBy("y").count().collect()}
    stands_for = tuple(max(1.0, n.get(y, 0) / MOST_DOCS) for y in (0, 1))
    model = train([r["text"] for r in sample], [r["y"] for r in sample], stands_for=stands_for)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
