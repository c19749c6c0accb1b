"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import with_rank
from .common import Scratch

SIZE, END = 1024, 0
#: Rank files hold the vocabulary of the tokenizer file of the same name.
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Words longer than this go through the tokenizers library, whose merges don't slow down
#: with the square of a word's length.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them for the JSON file.

    Most texts are encoded from the rank file of the same vocabulary, which takes a
    quarter of the time; both ways give the same ids (tests/llm/test_packing.py).
    """

    def __init__(self, tokenizer: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = public_tokenizers.path(f"{tokenizer}.json"), None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or LONG_RUN.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def _cut(size: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for a in range(0, len(ids), size):
                    part = ids[a : a + size]
                    rows.append((a, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    at.append(i)
            values = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, values.T)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids cut at multiples of size."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(_cut(size, tokenizer), schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs) for all counted lengths.

    Lengths go longest first; each goes to the shortest open pack that still fits it, or
    opens a new pack. Equal packs are one pattern with a count, so the work depends on
    the number of lengths and patterns, not on the number of pieces.
    """
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        used = 1
        while left and used + length <= size:
            if not open_[used]:
                used += 1
                continue
            pack, count = open_[used].pop()
            taken = min(left, count)
            if taken < count:
                open_[used].append((pack, count - taken))
            open_[used + length].append(((*pack, length), taken))
            left -= taken
        # Nothing open fits: a new pack takes as many as it holds before the next one opens.
        each = size // length
        if left >= each:
            open_[each * length].append(((length,) * each, left // each))
        if left % each:
            open_[left % each * length].append(((length,) * (left % each), 1))
    return [entry for level in open_ for entry in level]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each place that takes it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            found.setdefault(length, []).append((first, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in found.items()}


def _place(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = length == value
                first, base, place = places[int(value)]
                i = np.searchsorted(first, rank[at] - 1, side="right") - 1
                sequence[at] = base[i] + rank[at] - 1 - first[i]
                offset[at] = place[i]
            yield batch.drop_columns("rank").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Every document, null or empty texts included, ends with id 0; it is cut at multiples
    of size, so full pieces are sequences of their own and the rest is packed. The
    histogram of lengths (at most size rows) is all the driver gets. Pieces take the
    places of their length by rank in the order (doc_id, start, ids_crc32); the ranks of
    a length that most pieces share are counted over range partitions. Repeated rows are
    packed each, null ids too. No rows give no rows. Other columns are not read.
    """
    cut = scratch.table(pieces(docs, id_col, text_col, size, tokenizer))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = slots(patterns(histogram, size))
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    ranked = with_rank(cut, ["length"], order, "rank", group_rows=0)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    # The ranks are fixed by a written table, before the pieces' own table goes.
    return scratch.table(ranked, keep=True).mapInArrow(_place(places), schema)
