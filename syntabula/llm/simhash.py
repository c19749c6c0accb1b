"""SimHash near-duplicates by anchor points of a covering code, with or without an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, chunks, mixed
from .graph import components
from .hamming import majority, near_links, near_pairs

SHINGLE, SEED, BITS = 4, 42, 4
#: Length of the perfect one-error code whose words are the anchors; covering radius 1.
CODE = 31


def _hashed(texts: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and where each text's begin and end."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    bounds = [0]
    for text in texts:
        words = text.lower().split()
        if words:
            line = memoryview(b" ".join(words))
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words]).tolist()
            stops = (ends - 1)[size - 1 :].tolist() or [len(line)]
            hashes.extend([digest(line[a:b], seed) for a, b in zip(starts, stops)])
        bounds.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(bounds)


def _shingles(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, texts in chunks(batch.column(1)):
                out[first : first + len(texts)] = majority(*_hashed(texts, size, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp): SimHash of the whole text.

    A-Z is lower-cased, words are split at ASCII white space, shingles are joined by one
    space and hashed by XXH64; a bit is set if over half of the hashes, repeats included,
    have it. Fewer words than a shingle: the whole sequence. No words or null: 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_shingles(shingle, seed), f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def part_anchors(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into word, anchor) of every code word within 2 of each CODE-bit word.

    The code is perfect with radius 1: the exclusive-or of the places of the set bits
    is 0 for a code word and else the place of the one wrong bit. Two words within 2 of
    each other have a point within 1 of both; the anchor that covers it (radius 1) is
    within 1 + 1 = 2 of both: the covering radius plus each side's half of the threshold.
    """
    #: weight2[s]: the words of two set bits whose places have exclusive-or s.
    weight2 = np.zeros((CODE + 1, CODE // 2), np.uint64)
    for s in range(1, CODE + 1):
        weight2[s] = sorted({(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE + 1) if i != s})
    syndrome = np.zeros(len(word), np.uint64)
    for place in np.arange(1, CODE + 1, dtype=np.uint64):
        syndrome ^= ((word >> (place - np.uint64(1))) & np.uint64(1)) * place
    off = syndrome > 0
    flip = np.where(off, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
    far = np.flatnonzero(off)
    around = word[far][:, None] ^ weight2[syndrome[far].astype(np.int64)]
    return np.concatenate([np.arange(len(word)), np.repeat(far, weight2.shape[1])]), np.concatenate([word ^ flip, around.ravel()])


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, key) of every anchor near each fingerprint.

    The 64 bits give two words of CODE bits. Fingerprints within 4 bits are within 2 in
    one of the words, and share an anchor there.
    """
    index, keys = [], []
    for half in (0, 1):
        at, anchor = part_anchors((fps >> np.uint64(32 * half)) & np.uint64((1 << CODE) - 1))
        index.append(at)
        keys.append(anchor | np.uint64(half << CODE))
    return np.concatenate(index), np.concatenate(keys)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        index, keys = anchors(fps.view(np.uint64))
        yield pd.DataFrame({"key": keys.view(np.int64), "fp": fps[index]})


def near_duplicates(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Fingerprints that differ in at most 4 bits are linked; component_id is the least id
    reachable. Rows with equal fingerprints are one node, so exact copies are never
    paired. Repeated rows stay; rows whose id is null belong to the component of their
    fingerprint, and component_id is null only if all its ids are. An empty table gives
    an empty one; other columns are not read.
    """
    marked = scratch.table(fingerprints(docs, id_col, text_col, shingle), keep=True)
    nodes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keyed = nodes.select("fp").mapInPandas(_replicate, "key long, fp long")
    labels = components(scratch, near_links(scratch, keyed, BITS))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    named = scratch.table(named)
    roots = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = scratch.table(named.join(roots, "label").select("fp", "component_id"), keep=True)
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


#: Documents are similar if so great a part of their distinct shingles is common to both.
SIMILARITY = 0.8
#: Candidates share one of BANDS keys of BAND_ROWS least hashes each: at similarity 0.8 a
#: key is shared with chance 0.8 ** 6, none of 24 with chance 0.0007.
BANDS, BAND_ROWS = 24, 6
#: Keys and names are compared as they are: every two of a key are a pair.
_ANY = 64


def _sets(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each slice, in order."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]


def _band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(slices, BANDS) keys of the least hashes of each slice; empty slices have equal keys."""
    full = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for row in range(BAND_ROWS):
            if len(full):
                salt = mixed(np.array([band * BAND_ROWS + row + 1], np.uint64))
                least = np.minimum.reduceat((hashes ^ salt) * (mixed(salt) | np.uint64(1)), bounds[full])
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[full, band] = key
    return keys


def _marks(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fps = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            for first, texts in chunks(batch.column(1)):
                hashes, bounds = _hashed(texts, size, seed)
                names[first : first + len(texts)] = [xxhash.xxh64_intdigest(s.tobytes()) for s in _sets(hashes, bounds)]
                fps[first : first + len(texts)] = majority(hashes, bounds)
                keys[first : first + len(texts)] = _band_keys(hashes, bounds)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names.view(np.int64)), pa.array(fps.view(np.int64)), listed],
                names=["doc_id", "text_hash", "id", "fp", "keys"],
            )

    return run


def _listed_sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                sets = _sets(*_hashed(texts, size, seed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = (side.values.to_numpy(zero_copy_only=False) for side in (left, right))
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9 else 0
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _similar(scratch: Scratch, pairs: DataFrame, marked: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of names whose sets of shingles are similar enough, as a written table."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = scratch.table(marked.join(needed, "id", "left_semi").groupBy("id").agg(F.min("text_hash").alias("text_hash")))
    found = rows.select("text_hash", "text").join(texts, "text_hash").select("id", "text")
    sets = found.mapInArrow(_listed_sets(shingle, SEED), "id long, shingles array<long>").dropDuplicates(["id"])
    sets = scratch.table(sets)
    sides = [sets.select(F.col("id").alias(c), F.col("shingles").alias(n)) for c, n in (("a", "left"), ("b", "right"))]
    return scratch.table(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(similarity), "a long, b long"))


def anchor_pairs(scratch: Scratch, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of names of (id, fp), linked by fingerprints as in near_duplicates().

    Fingerprints that share an anchor and differ in at most BITS bits are linked, by a
    spanning forest per anchor. The least name of a fingerprint stands for it and is
    linked to its other names.
    """
    names = scratch.table(marked.select("fp", "id").distinct())
    first = scratch.table(names.groupBy("fp").agg(F.min("id").alias("first")))
    links = near_links(scratch, first.select("fp").mapInPandas(_replicate, "key long, fp long"), BITS)
    sides = [first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "left"), ("b", "right"))]
    near = links.join(sides[0], "a").join(sides[1], "b").select("left", "right")
    equal = names.join(first, "fp").select(F.col("first").alias("left"), F.col("id").alias("right"))
    both = near.union(equal).where("left <> right")
    return both.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()


def similar_documents(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, component_id, text_hash, group) for every row of docs, linked at the similarity of their sets of shingles.

    component_id is the least id of the group; two groups share it if that id has several
    texts, hence the number of the group, and the hash that tells rows of one id apart.

    Candidates are the links of SimHash fingerprints by anchors (anchor_pairs()). These reach
    pairs of few differing bits only, so texts that share a key of least hashes (BANDS,
    BAND_ROWS) are candidates too. Each candidate pair is verified by its whole sets, so no
    link is below the similarity, and of pairs at 0.8 one in 1,400 is no candidate (fewer
    above). 1. The links by anchors and a spanning forest per key are verified. 2. What is not
    connected then is compared pair by pair under its keys, but only between components.
    Texts of equal sets are one node. Texts without words are alike. Rows and nulls as in
    near_duplicates().
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, id long, fp long, keys array<long>"
    marked = scratch.table(rows.mapInArrow(_marks(shingle, SEED), schema), keep=True)
    nodes = scratch.table(marked.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("keys").alias("keys")))
    keyed = scratch.table(nodes.select(F.explode("keys").alias("key"), "id"))
    shared = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keyed = scratch.table(keyed.join(shared, "key", "left_semi"))
    banded = near_links(scratch, keyed.select("key", F.col("id").alias("fp")), _ANY)
    banded = banded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.table(anchor_pairs(scratch, marked).union(banded).distinct())
    good = _similar(scratch, pairs, marked, rows, shingle, similarity)
    labels = components(scratch, good)
    named = keyed.join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    named = named.select("key", F.col("id").alias("fp"), "id", F.coalesce("label", "id").alias("label"))
    crossing = near_pairs(scratch, named, _ANY).join(pairs, ["a", "b"], "left_anti")
    more = _similar(scratch, scratch.table(crossing), marked, rows, shingle, similarity)
    labels = scratch.table(components(scratch, good.union(more)))
    grouped = nodes.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("id", "least", F.coalesce("label", "id").alias("label"))
    grouped = scratch.table(grouped)
    roots = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of = scratch.table(grouped.join(roots, "label").select("id", "component_id", F.col("label").alias("group")), keep=True)
    return marked.join(of, "id").select("doc_id", "component_id", "text_hash", "group")
