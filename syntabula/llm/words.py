"""Repeated word windows by recompression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shards
from .common import Scratch, mixed
from .shards import Shard

WINDOW = 35
#: Rounds of pair naming after the naming of runs, and the least number of words of a
#: symbol that is asked about: shorter ones repeat by chance too often to tell anything.
ROUNDS, LEAST_SIZE = 4, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of an ordered pair of names: the same everywhere, without a dictionary."""
    return mixed(mixed(left * _A + np.uint64(1)) + right * _B)


class Words:
    """The words of a shard as names; a separator (0) stands before, between and after documents."""

    def __init__(self, texts: list[bytes]):
        self.lists = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.lists], np.int64)
        self.first = np.cumsum(np.r_[1, sizes[:-1] + 1])
        self.sizes = sizes
        self.names = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.uint64)
        digest = xxhash.xxh64_intdigest
        for at, words in zip(self.first, self.lists):
            self.names[at : at + len(words)] = np.fromiter(map(digest, words), np.uint64, len(words))
        inside = np.ones(len(self.names), bool)
        inside[0] = False
        inside[self.first + sizes] = False
        # No word is named like the separator.
        self.names[inside & (self.names == 0)] = 1
        self.inside = inside

    def starts(self, window: int) -> np.ndarray:
        """Places where a window lies within one document."""
        ok = np.zeros(len(self.names), bool)
        for at, n in zip(self.first, self.sizes):
            if n >= window:
                ok[at : at + n - window + 1] = True
        return ok


def recompress(names: np.ndarray, inside: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, size, low, high) after the rounds, without separators.

    The first round names runs of equal words by (word, length). Each further round
    deals the symbols into left and right ones by a bit of their name, and names every
    pair of a left one followed by a right one; such pairs never overlap. low:high are
    the words that decided how the symbol came about. So wherever the words low:high
    stand, this very symbol stands too: a window that holds low:high and repeats
    elsewhere brings the symbol along.
    """
    n = len(names)
    symbol, low, high, size = names, np.arange(n), np.arange(1, n + 1), np.ones(n, np.int64)
    solid = inside
    # Runs: where one ends depends on both neighbours.
    start = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | ~solid[1:]])
    end = np.r_[start[1:], n]
    length = end - start
    symbol = np.where(length > 1, named(symbol[start], length.astype(np.uint64)), symbol[start])
    size, solid = length, solid[start]
    low, high = np.maximum(start - 1, 0), np.minimum(end + 1, n)
    for r in range(rounds):
        left = (mixed(symbol + np.uint64(r * int(_A) % 2**64)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = left[:-1] & ~left[1:] & solid[:-1] & solid[1:]
        # A single left symbol depends on its right neighbour, a right one on its left.
        after, before = np.r_[np.arange(1, len(symbol)), len(symbol) - 1], np.r_[0, np.arange(len(symbol) - 1)]
        other = np.where(pair | left, after, before)
        low, high = np.minimum(low, low[other]), np.maximum(high, high[other])
        second = np.r_[False, pair[:-1]]
        symbol = np.where(pair, named(symbol, symbol[after] + np.uint64(r)), symbol)[~second]
        size = np.where(pair, size + size[after], size)[~second]
        low, high, solid = low[~second], high[~second], solid[~second]
    return symbol[solid], size[solid], low[solid], high[solid]


def _asked(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbol, size, low, high = recompress(words.names, words.inside)
    use = (size >= LEAST_SIZE) & (high - low <= window)
    return symbol[use], low[use], high[use]


def window_names(names: np.ndarray, window: int) -> np.ndarray:
    """Name of each window, from names of blocks of doubling length."""
    parts, block, width, rest = [], names, 1, window
    while rest:
        if rest & 1:
            parts.append((width, block))
        rest >>= 1
        if rest:
            block = named(block[:-width], block[width:])
            width *= 2
    n, out, at = len(names) - window + 1, None, 0
    for width, block in parts:
        piece = block[at : at + n]
        out = piece if out is None else named(out, piece)
        at += width
    return out if n > 0 else np.empty(0, np.uint64)


def _symbol_keys(window: int):
    def make(row: dict) -> tuple[np.ndarray, None]:
        words = Words(Shard.of(row["ids"], row["sizes"], row["data"]).texts)
        return np.unique(_asked(words, window)[0]), None

    return make


def _candidates(window: int):
    """Keeps the documents with windows whose symbols all repeat, and those windows' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row["ids"], row["sizes"], row["data"])
                words = Words(shard.texts)
                symbol, low, high = _asked(words, window)
                keys, inverse, counts = np.unique(symbol, return_inverse=True, return_counts=True)
                alone = ~((counts > 1) | shards.bits_of(row["answers"]))[inverse]
                out = np.zeros(len(words.names) + 1, np.int32)
                np.add.at(out, np.maximum(high[alone] - window, 0), 1)
                np.add.at(out, low[alone] + 1, -1)
                open_ = words.starts(window) & (np.cumsum(out)[:-1] == 0)
                dirty = [i for i, (a, n) in enumerate(zip(words.first, words.sizes)) if open_[a : a + n].any()]
                clean = sorted(set(range(len(shard.ids))) - set(dirty))
                some = Shard([shard.ids[i] for i in dirty], [shard.texts[i] for i in dirty])
                # Places counted in the reduced shard.
                shift, at = [], 1
                for i in dirty:
                    a, n = words.first[i], words.sizes[i]
                    shift.append(np.flatnonzero(open_[a : a + n]) + at)
                    at += n + 1
                places = np.concatenate(shift) if shift else np.empty(0, np.int64)
                yield _state(row["shard"], some, places, [shard.ids[i] for i in clean], [b" ".join(words.lists[i]) for i in clean], words.sizes[clean])

    return run


_RESULT = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string())]))
_STATE = "shard long, ids array<long>, sizes array<long>, data binary, places binary, n_places long, clean array<struct<doc_id:long,n_words:long,kept:string>>"


def _state(number, some: Shard, places: np.ndarray, ids: list, kept: list[bytes], sizes: np.ndarray) -> pa.RecordBatch:
    a, b, c = some.row()
    clean = [{"doc_id": i, "n_words": int(n), "kept": shards.sha256(k)} for i, k, n in zip(ids, kept, sizes)]
    columns = [
        pa.array([number], pa.int64()), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64())), pa.array([c], pa.binary()),
        pa.array([shards.pack(places)], pa.binary()), pa.array([len(places)], pa.int64()), pa.array([clean], _RESULT),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "sizes", "data", "places", "n_places", "clean"])


def _windows(row: dict, window: int) -> tuple[Shard, Words, np.ndarray, np.ndarray]:
    shard = Shard.of(row["ids"], row["sizes"], row["data"])
    words = Words(shard.texts)
    places = shards.unpack(row["places"]).astype(np.int64)
    names = window_names(words.names, window)[places] if len(places) else np.empty(0, np.uint64)
    return shard, words, places, names


def _window_keys(window: int):
    return lambda row: (np.unique(_windows(row, window)[3]), None)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, words, places, names = _windows(row, window)
                keys, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
                again = ((counts > 1) | shards.bits_of(row["answers"]))[inverse]
                cover = np.zeros(len(words.names) + window + 1, np.int32)
                np.add.at(cover, places[again], 1)
                np.add.at(cover, places[again] + window, -1)
                gone = np.cumsum(cover) > 0
                rows = [(r["doc_id"], r["n_words"], 0, r["kept"], []) for r in row["clean"]]
                for i, a, n, own in zip(shard.ids, words.first, words.sizes, words.lists):
                    mask = gone[a : a + n]
                    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                    spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
                    kept = b" ".join([w for w, g in zip(own, mask) if not g]) if spans else b" ".join(own)
                    rows.append((i, int(n), int(mask.sum()), shards.sha256(kept), spans))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "spans"), r)) for r in rows], schema=_OUT
                )

    return run


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def repeated_windows(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of every row of docs.

    A word is removed if it lies in a window of `window` words whose sequence also
    starts anywhere else, in the same document too; windows are judged on the input.
    spans are the removed runs as word numbers, end exclusive; kept_sha256 is that of
    the kept words joined by one space.

    Recompression gives every shard its symbols; shards ask each other which symbols
    they share. A window with a symbol of its own that occurs only once can't repeat;
    windows left over are compared themselves, by names of their whole sequence (64
    bits), which decides. Words are split at ASCII white space. Null and empty texts have
    no words, a shorter text than a window loses nothing, a repeated row is another
    place where its windows start, and null ids stay null. Ids are whole numbers. No
    rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with shards.small_batches(spark):
        table = shards.build(scratch, docs, id_col, text_col)
        size = table.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
        shared = scratch.table(shards.ask(scratch, table, _symbol_keys(window), "elsewhere", size // 25))
        state = scratch.table(table.join(shared, "shard", "left").mapInArrow(_candidates(window), _STATE))
        n = state.agg(F.sum("n_places")).first()[0] or 0
        again = scratch.table(shards.ask(scratch, state, _window_keys(window), "elsewhere", n))
        result = state.join(again, "shard", "left").mapInArrow(
            _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
        )
        return scratch.table(result, keep=True)
