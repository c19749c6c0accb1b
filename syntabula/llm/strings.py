"""Repeated byte strings by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shards
from .common import Scratch, mixed
from .shards import LAST, Shard
from .suffixes import common_prefixes, eights, suffix_array

LENGTH = 50
#: Bytes of a gram; every string of LENGTH bytes has LENGTH - GRAM + 1 of them, of which
#: the least by hash stands for it. A chunk ends where a gram's hash has CHUNK_BITS zeros.
GRAM, CHUNK_BITS = 20, 7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(32))) * _A + b * _B


def _gram_hashes(words: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Hash of the gram at each of the first n places."""
    return mixed(_fold(_fold(words[:n], words[8 : 8 + n]), words[gram - 8 : gram - 8 + n]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    block, have = values, 1
    while have * 2 <= width:
        block = np.minimum(block[:-have], block[have:])
        have *= 2
    rest = width - have
    return np.minimum(block[:-rest], block[rest:]) if rest else block


class Grams:
    """What a shard's strings are asked by.

    chunk_key, chunk_doc: each document is cut where a gram's content says so; a chunk's
    key names all strings that start in it (its bytes and the LENGTH - 1 after them).
    run_key, run_context: strings in a row whose least gram is the same one, with a name
    of the chunks that they start in.
    """

    def __init__(self, shard: Shard, length: int, gram: int = GRAM):
        self.shard, self.length = shard, length
        self.text = b"".join(shard.texts)
        sizes = np.array([len(t) for t in shard.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(self.text)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        words = eights(self.text + bytes(length + 16))
        hashes = _gram_hashes(words, n, gram)
        # A string starts where LENGTH bytes of its document are left.
        self.starts = np.arange(n) + length <= self.ends[self.doc] if n else np.zeros(0, bool)
        cut = (hashes & np.uint64((1 << CHUNK_BITS) - 1)) == 0
        cut[self.begins[sizes > 0]] = True
        self.chunk_at = np.flatnonzero(cut)
        self.chunk = np.cumsum(cut) - 1
        after = np.r_[self.chunk_at[1:], n]
        self.chunk_doc = self.doc[self.chunk_at]
        stops = np.minimum(after + length - 1, self.ends[self.chunk_doc])
        view, digest = memoryview(self.text), xxhash.xxh64_intdigest
        self.chunk_key = np.fromiter((digest(view[a:b]) for a, b in zip(self.chunk_at.tolist(), stops.tolist())), np.uint64, len(after))
        places = np.flatnonzero(self.starts)
        least = _least(np.r_[hashes, np.zeros(length, np.uint64)], length - gram + 1)[places]
        new = np.r_[True, (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1)] if len(places) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(places)] - 1
        self.places, self.run = places, np.cumsum(new) - 1
        # Least hashes are small numbers; mixed anew they fill all key ranges evenly.
        self.run_key = mixed(least[first])
        total = np.r_[np.uint64(0), np.cumsum(mixed(self.chunk_key), dtype=np.uint64)]
        a, b = (self.chunk[places[first]], self.chunk[places[last]]) if len(places) else (np.empty(0, np.int64),) * 2
        self.run_context = mixed(total[b + 1] - total[a] + (b - a).astype(np.uint64)).view(np.int64)

    def chunk_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, their least document, entry of each chunk)."""
        keys, inverse = np.unique(self.chunk_key, return_inverse=True)
        least = np.full(len(keys), LAST)
        np.minimum.at(least, inverse, self.shard.order[self.chunk_doc])
        return keys, least, inverse

    def run_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, contexts: least and, if other, greatest of each key; first entry of each run; its key varies here)."""
        keys, inverse = np.unique(self.run_key, return_inverse=True)
        least, most = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, inverse, self.run_context)
        np.maximum.at(most, inverse, self.run_context)
        two = least < most
        at = np.arange(len(keys)) + np.r_[0, np.cumsum(two)[:-1]] if len(keys) else np.empty(0, np.int64)
        out_keys, out_values = np.repeat(keys, 1 + two), np.repeat(least, 1 + two)
        out_values[at[two] + 1] = most[two]
        return out_keys, out_values, at[inverse], two[inverse]


def _shard(row: dict) -> Shard:
    return Shard.of(row["ids"], row["sizes"], row["data"])


def _chunk_keys(length: int):
    return lambda row: Grams(_shard(row), length).chunk_entries()[:2]


def _run_keys(length: int):
    return lambda row: Grams(_shard(row), length).run_entries()[:2]


def equal_strings(text: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, True where a new string begins) for the strings at the places.

    Only the stretches that the strings cover are sorted.
    """
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length, -1)
    inside = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    # Stretches one after the other, a zero byte between them; strings never reach it.
    part = b"\0".join([text[a:b] for a, b in zip(begin, end)])
    shift = begin - (np.cumsum(end - begin + 1) - (end - begin + 1))
    stretch = np.searchsorted(begin, places, side="right") - 1
    wanted = np.zeros(len(part), bool)
    wanted[places - shift[stretch]] = True
    order, _ = suffix_array(part, length)
    fresh = np.cumsum(common_prefixes(part, order, length) < length)
    use = wanted[order]
    order, fresh = order[use], fresh[use]
    # Back to places of the text.
    starts = begin - shift
    origin = order + shift[np.searchsorted(starts, order, side="right") - 1]
    return origin, np.r_[True, fresh[1:] != fresh[:-1]] if len(fresh) else np.zeros(0, bool)


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _covered(places: np.ndarray, n: int, length: int) -> np.ndarray:
    cover = np.zeros(n + length + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length, -1)
    return np.cumsum(cover[:n]) > 0


def _result(key, text: bytes, mask: np.ndarray) -> dict:
    spans = _spans(mask)
    kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text
    return {"doc_id": key, "n_bytes": len(text), "n_removed": int(mask.sum()), "kept_sha256": shards.sha256(kept), "spans": spans}


_ROW = pa.struct(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_SQL_ROW = "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_STATE = f"shard long, ids array<long>, sizes array<long>, data binary, gone binary, reps binary, n_reps long, done array<struct<{_SQL_ROW.replace('doc_id long', 'doc_id:long').replace('n_bytes long', 'n_bytes:long').replace('n_removed long', 'n_removed:long').replace('kept_sha256 string', 'kept_sha256:string').replace('spans array', 'spans:array')}>>"


def _settle(length: int):
    """Removes what this shard and whole chunks settle; keeps documents with strings to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _settled(row, length)

    return run


def _settled(row: dict, length: int) -> pa.RecordBatch:
    shard = _shard(row)
    grams = Grams(shard, length)
    order = shard.order
    _, least, entry = grams.chunk_entries()
    elsewhere = shards.bits_of(row["chunk_answers"])
    chunk_gone = (order[grams.chunk_doc] > least[entry]) | elsewhere[entry]
    _, _, first, varies = grams.run_entries()
    open_run = varies | shards.bits_of(row["run_answers"])[first]
    gone = chunk_gone[grams.chunk[grams.places]] if len(grams.places) else np.zeros(0, bool)
    places = grams.places[~gone & open_run[grams.run]] if len(grams.places) else grams.places
    removed = [grams.places[gone]]
    reps = places
    if len(places):
        origin, fresh = equal_strings(grams.text, places, length)
        docs = order[grams.doc[origin]]
        heads = np.flatnonzero(fresh)
        smallest = np.minimum.reduceat(docs, heads)[np.cumsum(fresh) - 1]
        removed.append(origin[docs > smallest])
        reps = np.sort(origin[docs == smallest])
    away = np.sort(np.concatenate(removed))
    mask = _covered(away, len(grams.text), length)
    dirty = np.zeros(len(shard.ids), bool)
    dirty[grams.doc[reps]] = True
    done = [
        _result(key, text, mask[a:b])
        for key, text, a, b, d in zip(shard.ids, shard.texts, grams.begins, grams.ends, dirty)
        if not d
    ]
    some = Shard([i for i, d in zip(shard.ids, dirty) if d], [t for t, d in zip(shard.texts, dirty) if d])
    # Places counted in the documents that stay.
    sizes = grams.ends - grams.begins
    new_begin = np.cumsum(np.where(dirty, sizes, 0)) - np.where(dirty, sizes, 0)
    move = lambda p: p - grams.begins[grams.doc[p]] + new_begin[grams.doc[p]]
    away = away[dirty[grams.doc[away]]]
    a, b, c = some.row()
    columns = [
        pa.array([row["shard"]], pa.int64()), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64())), pa.array([c], pa.binary()),
        pa.array([shards.pack(move(away))], pa.binary()), pa.array([shards.pack(move(reps))], pa.binary()), pa.array([len(reps)], pa.int64()),
        pa.array([done], pa.list_(_ROW)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "sizes", "data", "gone", "reps", "n_reps", "done"])


def _compared(row: dict, length: int) -> tuple[Shard, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, its text, places to compare, distinct string names, least document of each, name of each place."""
    shard = _shard(row)
    text = b"".join(shard.texts)
    reps = shards.unpack(row["reps"]).astype(np.int64)
    words = eights(text + bytes(length + 16))
    name = np.zeros(len(reps), np.uint64)
    for at in [*range(0, length - 7, 8), length - 8]:
        name = mixed(name * _A + words[reps + at])
    keys, inverse = np.unique(name, return_inverse=True)
    owner = np.repeat(shard.order, [len(t) for t in shard.texts])[reps]
    least = np.full(len(keys), LAST)
    np.minimum.at(least, inverse, owner)
    return shard, text, reps, keys, least, inverse


def _string_keys(length: int):
    return lambda row: _compared(row, length)[3:5]


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, text, reps, _, _, inverse = _compared(row, length)
                earlier = shards.bits_of(row["answers"])
                away = reps[earlier[inverse]] if len(reps) else reps
                mask = _covered(np.concatenate([shards.unpack(row["gone"]).astype(np.int64), away]), len(text), length)
                rows, at = list(row["done"]), 0
                for key, own in zip(shard.ids, shard.texts):
                    rows.append(_result(key, own, mask[at : at + len(own)]))
                    at += len(own)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_ROW)))

    return run


def repeated_strings(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept_sha256, spans of every row of docs.

    A byte is removed if a string of `length` bytes that covers it also starts in a
    document with a smaller id; strings lie within one document and are judged on the
    input. spans are the maximal removed runs in UTF-8 bytes, end exclusive.

    1. Chunks cut by content: a chunk whose strings all start in a smaller document is
       settled at once, so long copies cost one key per chunk.
    2. A string whose least gram always stands between the same chunks has nothing left
       to find; the others are compared, in every shard by its suffix array and common
       prefixes: equal strings are neighbours there.
    3. What only other shards can tell: the shards' distinct strings, named by 64 bits,
       are merged in order by binary search, with the least document of each.

    Null and empty texts have no bytes. Rows with the same id never remove from each
    other; a null id counts as greater than all others. Ids are whole numbers. No rows
    give no rows; other columns are not read. A task holds about 150 bytes per byte of
    its shard, which is SHARD_BYTES or one longer document.
    """
    spark = docs.sparkSession
    with shards.small_batches(spark):
        table = shards.build(scratch, docs, id_col, text_col)
        size = table.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
        ask = shards.ask
        chunk = scratch.table(ask(scratch, table, _chunk_keys(length), "smaller", size >> CHUNK_BITS).withColumnRenamed("answers", "chunk_answers"))
        run = scratch.table(ask(scratch, table, _run_keys(length), "differs", size // 16).withColumnRenamed("answers", "run_answers"))
        answers = chunk.join(run, "shard", "left")
        state = scratch.table(table.join(answers, "shard", "left").mapInArrow(_settle(length), _STATE))
        n = state.agg(F.sum("n_reps")).first()[0] or 0
        last = scratch.table(ask(scratch, state, _string_keys(length), "smaller", n))
        return scratch.table(state.join(last, "shard", "left").mapInArrow(_finish(length), _SQL_ROW), keep=True)
