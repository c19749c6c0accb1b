"""Hard negatives of embedding rows, found by bounds from segment summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, partitions_for
from .shards import small_batches

#: Every row whose id is divisible by this is an anchor.
ANCHOR_EVERY, TOP = 100, 5
#: Least share of the positive's score that a negative reaches, as a fraction.
LEAST = (80, 100)
#: A component counts as floor(SCALE * x).
SCALE = 256
#: Segments of each level, coarse to fine; each divides the next.
LEVELS = (1, 4, 16)
#: Rows and anchors of a stored block, blocks' rows that a task holds at a time.
BLOCK_ROWS, ANCHOR_ROWS, SHARD_ROWS = 1024, 64, 65_536
#: Below this all sums of products are whole numbers that a double holds.
_EXACT = 2.0**53
_LONG = np.iinfo(np.int64)
#: Summaries are stored in single precision; bounds are widened by this share of their terms.
_SLACK = 1e-5


def summaries(values: np.ndarray, segments: int = LEVELS[-1]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row; values has a multiple of that many columns."""
    parts = values.reshape(len(values), segments, -1)
    return parts.mean(axis=2), parts.std(axis=2)


def coarser(mean: np.ndarray, deviation: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of fewer segments from those of more."""
    n = len(mean)
    m, d = mean.reshape(n, segments, -1), deviation.reshape(n, segments, -1)
    whole = m.mean(axis=2)
    return whole, np.sqrt((d**2).mean(axis=2) + ((m - whole[:, :, None]) ** 2).mean(axis=2))


class Block:
    """Rows (or anchors) with their segment summaries at every level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, mean: np.ndarray, deviation: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        self.width = values.shape[1]
        self.largest = float(np.abs(values).max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.levels = [coarser(mean.astype(np.float64), deviation.astype(np.float64), s) for s in LEVELS]

    @staticmethod
    def make(ids: list, labels: list, vectors: list, width: int) -> Block:
        values = np.zeros((len(ids), width))
        for row, vector in zip(values, vectors):
            row[: len(vector)] = np.floor(SCALE * np.asarray(vector, np.float64))
        return Block(np.array(ids, np.int64), np.array(labels, np.int64), values, *summaries(values))

    def row(self) -> list:
        """ids, labels, kind of numbers, values, means, deviations."""
        kind = next(k for k in ("<i2", "<i4", "<f8") if k == "<f8" or self.largest <= np.iinfo(k).max)
        mean, deviation = self.levels[-1]
        with np.errstate(over="ignore"):
            stored = [a.astype("<f4").tobytes() for a in (mean, deviation)]
        return [self.ids.tobytes(), self.labels.tobytes(), kind, zstandard.compress(self.values.astype(kind).tobytes(), 1), *stored]

    @staticmethod
    def of(row: dict) -> Block:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        values = np.frombuffer(zstandard.decompress(row["data"]) if len(ids) else b"", row["kind"]).astype(np.float64).reshape(len(ids), -1)
        mean, deviation = (np.frombuffer(row[c], "<f4").reshape(len(ids), -1) for c in ("means", "deviations"))
        return Block(ids, labels, values, mean, deviation)


BLOCK_SCHEMA = "ids binary, labels binary, kind string, data binary, means binary, deviations binary"
_NAMES = [c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")]


def _exact(a: Block, rows: Block) -> bool:
    return a.largest * rows.largest * a.width < _EXACT


def scores(a: Block, rows: Block, at: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all anchors with the rows at; beyond a long: its limit."""
    if _exact(a, rows):
        return (a.values @ rows.values[at].T).astype(np.int64)
    whole = lambda v: np.array([[int(x) for x in r] for r in v], object).reshape(v.shape)
    exact = whole(a.values).dot(whole(rows.values[at]).T)
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def candidates(a: Block, rows: Block, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Places of rows that may score from low to high with some anchor that they are allowed for.

    In a segment of m components the product of two parts is m times the means' product,
    give or take m times the deviations' product (Cauchy and Schwarz on what is left of
    the means). Rows that a level leaves with no anchor are not refined further. Blocks
    whose products may outgrow doubles are scored without bounds.
    """
    at = np.flatnonzero(allowed.any(axis=0))
    if not _exact(a, rows):
        return at
    floor, ceiling = low[:, None].astype(np.float64), high[:, None].astype(np.float64)
    open_ = allowed[:, at]
    for (ma, da), (mr, dr), segments in zip(a.levels, rows.levels, LEVELS):
        if not len(at):
            break
        m = a.width / segments
        middle = m * (ma @ mr[at].T)
        spread = m * (da @ dr[at].T) * (1 + _SLACK) + _SLACK * m * (np.abs(ma) @ np.abs(mr[at]).T) + 1
        open_ &= (middle + spread >= floor) & (middle - spread <= ceiling)
        stay = open_.any(axis=0)
        at, open_ = at[stay], open_[:, stay]
    return at


def _first(score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of them, by score from high to low, then by id."""
    if len(score) > 4 * top:
        keep = score >= np.partition(score, len(score) - top)[len(score) - top]
        score, ids = score[keep], ids[keep]
    # ~score falls as the score rises, for every long.
    order = np.lexsort((ids, np.invert(score)))[:top]
    return score[order], ids[order]


class Positives:
    """The best rows of an anchor's own label."""

    def __init__(self, anchors: Block, rows: dict, top: int):
        self.anchors, self.top = anchors, top
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in anchors.ids]

    def take(self, rows: Block) -> None:
        a = self.anchors
        allowed = (a.labels[:, None] == rows.labels) & (a.ids[:, None] != rows.ids)
        low = np.array([s[-1] if len(s) == self.top else _LONG.min for s, _ in self.best])
        at = candidates(a, rows, low, np.full(len(low), _LONG.max), allowed)
        found = scores(a, rows, at)
        for i, (score, ids) in enumerate(self.best):
            use = allowed[i, at] & (found[i] >= low[i])
            if use.any():
                self.best[i] = _first(np.r_[score, found[i, use]], np.r_[ids, rows.ids[at[use]]], self.top)

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        columns = [np.repeat(self.anchors.ids, n), *(np.concatenate(c) for c in zip(*((ids, s) for s, ids in self.best)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """For each positive of an anchor, the best rows of other labels in its window of scores."""

    def __init__(self, anchors: Block, row: dict, top: int):
        self.anchors, self.top = anchors, top
        self.ids = [np.array(x, np.int64) for x in row["positive_ids"]]
        self.high = [np.array(x, np.int64) for x in row["positive_scores"]]
        none = np.empty(0, np.int64)
        self.best = [[(none, none) for _ in x] for x in self.ids]
        # least * positive <= whole * negative, rounded up without leaving the range of longs;
        # a positive below 0 has an empty window.
        least, whole = LEAST
        self.low = [np.array([-(-least * int(p) // whole) if p >= 0 else _LONG.max for p in x], np.int64) for x in self.high]

    def take(self, rows: Block) -> None:
        a = self.anchors
        # A full window takes nothing below its last score.
        low = [np.array([max(int(lo), int(s[-1])) if len(s) == self.top else lo for lo, (s, _) in zip(x, best)], np.int64) for x, best in zip(self.low, self.best)]
        allowed = (a.labels[:, None] != rows.labels) & (np.array([len(x) for x in low]) > 0)[:, None]
        least, most = (np.array([f(x) if len(x) else 0 for x in side], np.int64) for f, side in ((np.min, low), (np.max, self.high)))
        at = candidates(a, rows, least, most, allowed)
        found = scores(a, rows, at)
        for i, windows in enumerate(self.best):
            use = np.flatnonzero(allowed[i, at] & (found[i] >= least[i]) & (found[i] <= most[i]))
            score, ids = found[i, use], rows.ids[at[use]]
            for j, (s, n) in enumerate(windows if len(use) else ()):
                inside = (score >= low[i][j]) & (score <= self.high[i][j])
                if inside.any():
                    windows[j] = _first(np.r_[s, score[inside]], np.r_[n, ids[inside]], self.top)

    def rows(self) -> pa.RecordBatch:
        out = [
            (anchor, p, q, n, s)
            for anchor, ids, high, windows in zip(self.anchors.ids.tolist(), self.ids, self.high, self.best)
            for p, q, (score, negative) in zip(ids.tolist(), high.tolist(), windows)
            for s, n in zip(score.tolist(), negative.tolist())
        ]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=names)


def _search(find: type, top: int):
    """Rows of a shard come first and are held; then the anchors pass by, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, held = row["shard"], []
                block = Block.of(row)
                if not row["asks"]:
                    held.append(block)
                    continue
                found = find(block, row, top)
                for rows in held:
                    found.take(rows)
                yield found.rows()

    return run


def _blocks(width: int, size: int, positives: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]

        def out() -> pa.RecordBatch:
            cells = [pa.array([c]) for c in Block.make(held[0], held[1], held[2], width).row()]
            names = list(_NAMES)
            if positives:
                cells += [pa.array([c], pa.list_(pa.list_(pa.int64()))) for c in held[3:]]
                names += ["positive_ids", "positive_scores"]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for c, value in zip(held, row):
                    c.append(value)
                if len(held[0]) == size:
                    yield out()
        if held[0]:
            yield out()

    return run


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scratch: Scratch) -> DataFrame:
    """(id, label, vector): rows with an id, a label and finite components, one for each id."""
    vector = F.col(vector_col).cast("array<double>")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")).where(
        "id is not null and label is not null and vector is not null"
        " and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    # Ids alone are shuffled; the vectors only of ids that occur again.
    again = scratch.table(plain.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return plain
    one = plain.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    return scratch.table(plain.join(again, "id", "left_anti").unionByName(one))


def hard_negatives(
    scratch: Scratch,
    rows: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    every: int = ANCHOR_EVERY,
    top: int = TOP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(256 x); a row's score is its inner product with the anchor,
    higher first, ties by smaller id. Anchors are the rows whose id is divisible by every;
    the positives of one are its first top other rows of its label, and each positive's
    negatives the first top rows of other labels that score from 80 % of the positive to all of
    it. A positive that scores below 0 has none.

    Rows lie in blocks with the mean and deviation of each vector's segments. Each task holds
    the blocks of one shard while all anchors pass by in blocks: first for the positives,
    then, with their scores as windows, for the negatives. Bounds of 1, 4 and 16 segments rule
    rows out before they are scored; the best found so far narrow them. A task returns at most top
    rows for an anchor, or for a positive, and a ranked window over those of all shards keeps
    the first. Rows are never paired up in a join, and nothing grows with a label.

    Null ids, labels or vectors and components that are null or not finite: the row takes no part.
    Rows of one id are one row: the least by (label, components). Shorter vectors count as
    filled up with zeros. Scores beyond a long are its limits. No rows, or no anchors, give
    no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    plain = usable(rows, id_col, label_col, vector_col, scratch)
    asks = (F.col("id") % every == 0).cast("long")
    n, n_anchors, longest = plain.agg(F.count("*"), F.sum(asks), F.max(F.size("vector"))).first()
    width = max(1, -(-(longest or 0) // LEVELS[-1])) * LEVELS[-1]
    made = plain.mapInArrow(_blocks(width, BLOCK_ROWS, False), BLOCK_SCHEMA)
    # The number of a block is fixed by writing the table.
    stored = scratch.table(made.withColumn("block", F.monotonically_increasing_id()))
    n_shards = partitions_for(n, SHARD_ROWS, spark)
    n_tasks = partitions_for(n_anchors or 0, ANCHOR_ROWS * 64, spark)
    shards = stored.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(n_shards))).withColumn("asks", F.lit(False)).drop("block")

    def passing(anchors: DataFrame, find: type, schema: str) -> DataFrame:
        more = {f: F.lit(None).cast("array<array<long>>") for f in ("positive_ids", "positive_scores")} if find is Negatives else {}
        made = anchors.repartition(n_tasks, "id").mapInArrow(
            _blocks(width, ANCHOR_ROWS, bool(more)), BLOCK_SCHEMA + "".join(f", {f} array<array<long>>" for f in more)
        )
        blocks = scratch.table(made).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
        both = shards.withColumns(more).unionByName(blocks.withColumn("asks", F.lit(True)))
        return both.repartition(n_shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(_search(find, top), schema)

    anchors = scratch.table(plain.where(asks == 1))
    with small_batches(spark):
        found = passing(anchors, Positives, "anchor_id long, positive_id long, positive_score long")
        order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        positives = scratch.table(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    # At most top positives an anchor; an anchor without any has no negatives.
    listed = positives.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("ids"), F.collect_list("positive_score").alias("scores"))
    asked = anchors.join(listed, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "ids", "scores")
    asked = scratch.table(asked)
    with small_batches(spark):
        schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        found = scratch.table(passing(asked, Negatives, schema), keep=True)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(rows: DataFrame) -> DataFrame:
    """Labels of every seventh id moved on by one, so that near rows of another label exist."""
    return rows.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
