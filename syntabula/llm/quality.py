"""Graded quality by an ordinal cumulative-link model over hashed words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the hashed feature space, rated documents that are learned from (by order of a
#: hash of the id), and characters of the longest of them.
BITS, MOST_DOCS, MOST_CHARS = 16, 6000, 50_000
#: A document is kept if it reaches grade LEAST_GRADE with this probability.
LEAST_GRADE, LEAST_PROBABILITY = 1, 0.5
_SHAPE = bytes(
    ord("0") if chr(c).isdigit() and c < 128 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a whole text: its words, their shapes, and what their numbers say.

    A word counts by the root of its share, so long and short texts compare. A shape is
    the word with capitals, other letters, digits and signs told apart and runs as one.
    """
    words = text.split()
    names: list[bytes] = []
    values: list[float] = []
    n = max(1, len(words))
    own = Counter(words)
    for word, c in own.items():
        names.append(b"w" + word)
        values.append(c)
    shapes: Counter = Counter()
    for shape, c in Counter(text.translate(_SHAPE).split()).items():
        shapes[_RUN.sub(rb"\1", shape)] += c
    for shape, c in shapes.items():
        names.append(b"s" + shape)
        values.append(c)
    lines = [x for x in text.split(b"\n") if x.strip()]
    told = {
        b"length": min(12, int(np.log2(n)) if words else -1),
        b"distinct": 10 * len(own) // n,
        b"most": 10 * max(own.values(), default=0) // n,
        b"lines": 10 * len(set(lines)) // max(1, len(lines)),
        b"letters": len(text) // n if n < 3 or len(text) // n < 20 else 20,
    }
    for name, value in told.items():
        names.append(b"n%s%d" % (name, value))
        values.append(n)
    index = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) >> np.uint64(64 - BITS)
    return index.astype(np.int64), np.sqrt(np.array(values) / n)


class Model:
    """Shared weights and ordered thresholds: P(grade <= k) = logistic(thresholds[k] - score)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """For each text the probability of reaching grades 1, 2, ..."""
        score = np.array([self.weights[i] @ v for i, v in map(features, texts)])
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50))) if len(score) else np.zeros((0, len(self.thresholds)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of the cumulative-link model by adaptive gradient steps.

    rows: (index, value, grade). Thresholds are the first one and logarithms of the gaps
    between neighbours, so they stay in order. Without rows every grade above 0 is
    certain, so nothing is rejected.
    """
    if not rows:
        return Model(np.zeros(1 << BITS), np.full(grades - 1, -50.0))
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    grade = np.array([r[2] for r in rows])
    known, index = np.unique(index, return_inverse=True)
    w, cuts = np.zeros(len(known)), np.r_[-1.0, np.zeros(grades - 2)]
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, steps + 1):
        score = np.bincount(row, value * w[index], len(rows))
        theta = np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])])
        bounds = np.r_[-np.inf, theta, np.inf]
        above, below = sigmoid(bounds[grade + 1] - score), sigmoid(bounds[grade] - score)
        above[grade == grades - 1], below[grade == 0] = 1.0, 0.0
        p = np.maximum(above - below, 1e-9)
        da, db = above * (1 - above) / p, below * (1 - below) / p
        by_score = (da - db) / len(rows)
        gw = np.bincount(index, value * by_score[row], len(known)) + ridge * w
        by_theta = np.array([(db[grade == k + 1].sum() - da[grade == k].sum()) / len(rows) for k in range(grades - 1)])
        gc = np.r_[by_theta.sum(), [by_theta[k:].sum() * np.exp(cuts[k]) for k in range(1, grades - 1)]]
        for x, g, m, v in ((w, gw, moment[0], moment[1]), (cuts, gc, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        np.clip(cuts, -10, 10, out=cuts)
    weights = np.zeros(1 << BITS)
    weights[known] = w
    return Model(weights, np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])]))


def grade_of(labels: DataFrame) -> Column:
    """Ratings of the labels table: 0 poor, 1 good but toxic, 2 good; null if quality is."""
    return F.when(labels["quality"] == 0, 0).when((labels["quality"] == 1) & (labels["toxic"] == 1), 1).when(labels["quality"] == 1, 2)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()),
                batch.column("grade"),
            ],
            names=["doc_id", "index", "value", "grade"],
        )


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_DOCS) -> Model:
    """Model from at most `most` rated documents.

    ratings: doc_id, grade (0 to grades - 1; others and nulls are not used; of several
    ratings of a document the least counts).
    """
    usable = ratings.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= MOST_CHARS)
    some = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")
    schema = f"doc_id {dict(some.dtypes)['doc_id']}, index binary, value binary, grade int"
    got = sorted(some.mapInArrow(_sample, schema).toLocalIterator(), key=lambda r: (r["doc_id"], r["index"]))
    return fit([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4"), r["grade"]) for r in got], grades)


def _grade(model: Model, least_grade: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails([(t.as_py() or "").encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, least_grade - 1])], names=["doc_id", "expected_grade", "tail_probability"]
            )

    return run


def graded(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    least_grade: int = LEAST_GRADE, least_probability: float = LEAST_PROBABILITY,
) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row of docs.

    expected_grade is the mean grade, tail_probability that of least_grade or more; kept
    compares it with least_probability. Whole texts are scored; a null text is an empty
    one, which has a grade like others. Repeated rows are scored each, null ids stay, no
    rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, tail_probability double"
    return rows.mapInArrow(_grade(model, least_grade), schema).withColumn("kept", F.col("tail_probability") >= least_probability)


def _select(model: Model, text_col: str, least_grade: int, least_probability: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            tails = model.tails([(t.as_py() or "").encode() for t in texts])
            yield batch.filter(pa.array(tails[:, least_grade - 1] >= least_probability))

    return run


def selected(
    docs: DataFrame, model: Model, text_col: str = "text", least_grade: int = LEAST_GRADE, least_probability: float = LEAST_PROBABILITY
) -> DataFrame:
    """The rows of docs that graded() keeps, unchanged and with all columns."""
    return docs.mapInArrow(_select(model, text_col, least_grade, least_probability), docs.schema)
