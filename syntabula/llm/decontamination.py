"""Benchmark items inside documents, up to an error budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .edit import best_match, masks

#: Errors allowed per character of an item; shorter items are matched exactly, as whole words.
ERROR_RATE, LEAST_CHARS = 0.05, 20
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space; null is empty."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of almost equal length that make up the item."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


#: From here on scripts mostly write no spaces between words.
_UNSPACED = "\u2e80"


def whole_words(text: str, start: int, end: int) -> bool:
    """Neither edge of text[start:end] is inside a word; scripts without spaces have no inside."""
    edges = [text[i - 1 : i + 1] for i in (start, end) if 0 < i < len(text)]
    return not any(pair[0].isalnum() and pair[1].isalnum() and max(pair) < _UNSPACED for pair in edges)


class Matcher:
    """Items of one block. A near match keeps at least one of its budget + 1 pieces whole,
    so the piece's place says where to verify; nothing else has to be looked at."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, int(len(text) * rate) if len(text) >= LEAST_CHARS else 0, masks(text)) for key, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, budget, end) of every item within its budget of a part of the text."""
        if not self.items or not text:
            return []
        diagonals: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                diagonals.setdefault(i, set()).add(last + 1 - size - offset)
        out = []
        for i, starts in sorted(diagonals.items()):
            key, item, budget, places = self.items[i]
            if len(item) < LEAST_CHARS:
                ends = [s + len(item) for s in starts if whole_words(text, s, s + len(item))]
                out += [(key, 0, 0, min(ends))] if ends else []
                continue
            best, end, done = budget + 1, 0, None
            for low, high in _merged(sorted(starts), len(item) + budget, budget):
                low = max(0, low)
                got, at = best_match(item, text[low:high], places)
                if got < best:
                    best, end = got, low + at
            if best <= budget:
                out.append((key, best, budget, end))
        return out


def _merged(starts: list[int], reach: int, budget: int) -> Iterator[tuple[int, int]]:
    """Windows around the diagonals, overlapping ones joined."""
    low = high = None
    for s in starts:
        if high is not None and s - budget <= high:
            high = max(high, s + reach)
        else:
            if high is not None:
                yield low, high
            low, high = s - budget, s + reach
    if high is not None:
        yield low, high


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in blocks of at most BLOCK_CHARS characters (or one longer item).

    Rows come to the driver one partition at a time and only as the blocks are used.
    """
    held: list[tuple[object, str]] = []
    size = 0
    for key, text in items.select(id_col, text_col).toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield held


def _hits(items: list[tuple[object, str]], rate: float, types: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                rows += [(i, *hit) for hit in matcher.find(normal(text.as_py()))]
            index = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(index), pa.array([r[1] for r in rows], types), *[pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4)]],
                names=["doc_id", "item_id", "distance", "budget", "match_end"],
            )

    return run


def _item_type(items: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    field = items.schema[id_col]
    return field.dataType.simpleString(), to_arrow_type(field.dataType)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE,
) -> DataFrame:
    """(doc_id, item_id, distance, budget, match_end): items that a document holds.

    Texts are lower-cased and white space is collapsed. An item is held if some part of
    the document is within edit distance floor(rate x length) of it; distance is the
    least over the places checked, match_end the end of the first best place in the
    normalised text. Items shorter than LEAST_CHARS are held where they stand exactly, as whole
    words (whole_words()). Items without a character and nulls match nothing. Null texts are empty. Repeated rows and repeated items give repeated
    hits; null ids stay null. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    name, kind = _item_type(items, item_id)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {name}, distance int, budget int, match_end int"
    parts = [rows.mapInArrow(_hits(block, rate, kind), schema) for block in blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionAll, parts) if parts else rows.limit(0).mapInArrow(_hits([], rate, kind), schema)


def _keep(items: list[tuple[object, str]], rate: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in texts], pa.bool_()))

    return run


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """The rows of docs that hold no item, unchanged and with all columns; see contaminated()."""
    for block in blocks(items, item_id, item_text):
        docs = docs.mapInArrow(_keep(block, rate, text_col), docs.schema)
    return docs
