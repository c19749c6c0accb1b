"""Fingerprints and comparison of fingerprints that share a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, partitions_for

#: Fingerprints of one key that a task compares at a time, and rows of a partition.
BLOCK, TASK_ROWS = 4096, 1_000_000
#: Hashes whose bits are counted at a time.
BATCH = 65_536
#: Largest table of hot keys that is broadcast (16 bytes a row); a larger one is shuffled.
BROADCAST_ROWS = 200_000


#: The eight bits of each byte value as eight counters of a 64-bit number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Additions that such a counter holds.
_COUNTER = 255


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each slice bounds[i]:bounds[i+1]: bits set in over half of its hashes; empty: 0.

    64 counters of a byte each are added at a time, over at most _COUNTER hashes; the
    parts of a longer slice are added as wide numbers.
    """
    out = np.zeros(len(bounds) - 1, np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    at = 0
    while at < len(full):
        # As many slices as fit the batch, or one longer slice.
        stop = max(at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[at]] + BATCH, side="right")))
        rows = full[at:stop]
        size = bounds[rows + 1] - bounds[rows]
        parts = -(-size // _COUNTER)
        first = np.cumsum(parts) - parts
        inner = np.arange(int(parts.sum())) - np.repeat(first, parts)
        begin = bounds[rows[0]]
        cuts = np.repeat(bounds[rows] - begin, parts) + inner * _COUNTER
        bytes_ = hashes[begin : bounds[rows[-1] + 1]].view(np.uint8).reshape(-1, 8)
        counted = np.add.reduceat(_SPREAD[bytes_], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        ones = np.add.reduceat(counted.astype(np.int64), first, axis=0)
        out[rows] = ((2 * ones > size[:, None]) * powers).sum(axis=1, dtype=np.uint64)
        at = stop
    return out


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of a group exactly as all links would: at most n - 1."""
    left, right, rest = [], [], fps[1:]
    queue = [fps[0]]
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        one = queue.pop()
        near = np.bitwise_count(rest ^ one) <= bits
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), one))
            right.append(found)
            queue.extend(found)
            rest = rest[~near]
    none = np.empty(0, fps.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = [], []
        for batch in batches:
            keys.append(batch["key"].to_numpy())
            fps.append(batch["fp"].to_numpy())
        if not keys:
            return
        key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= bits]
        left, right = [fp[near]], [fp[near + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            a, b = _forest(fp[s : s + n], bits)
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        # The same pair meets under several keys.
        low, high = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([low, high], axis=1), axis=0)
        yield pd.DataFrame({"a": both[:, 0].view(np.int64), "b": both[:, 1].view(np.int64)})

    return run


def _across(bits: int):
    """All pairs of a key that are near and of different labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held).sort_values("key", kind="stable")
        key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        name, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for s, n in zip(starts, np.diff(np.r_[starts, len(key)])):
            f, who, of = fp[s : s + n], name[s : s + n], label[s : s + n]
            if n < 2 or (of == of[0]).all():
                continue
            left, right, size = [], [], 0
            for i in range(n - 1):
                near = np.flatnonzero((np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) & (of[i + 1 :] != of[i])) + i + 1
                left.append(np.minimum(who[near], who[i]))
                right.append(np.maximum(who[near], who[i]))
                size += len(near)
                # Pairs leave as they are found, so the task holds a batch of them.
                if size > BATCH or (size and i == n - 2):
                    yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
                    left, right, size = [], [], 0

    return run


def near_links(scratch: Scratch, keyed: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between fingerprints of (key, fp) that share a key and differ in at most bits.

    Per key only a spanning forest comes out, which joins the same fingerprints. fp must
    be distinct within a key.
    """
    return dealt(scratch, keyed.select("key", "fp"), "fp").mapInPandas(_compare(bits), "a long, b long")


def near_pairs(scratch: Scratch, keyed: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of ids of (key, fp, id, label) that share a key, differ in at most bits, and in their labels."""
    rows = dealt(scratch, keyed.select("key", "fp", "id", "label"), "id")
    return rows.mapInPandas(_across(bits), "a long, b long").distinct()


def dealt(scratch: Scratch, keyed: DataFrame, member: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows of a key together in one partition.

    A key with more than BLOCK rows is dealt out to pairs of blocks, each compared by
    its own task, so that no task holds a hot key.
    """
    spark = keyed.sparkSession
    rest = [c for c in keyed.columns if c != "key"]
    keyed = scratch.table(keyed)
    hot = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    n_hot = hot.count()
    out = keyed
    if n_hot:
        sized = keyed.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left")
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)).cast("long")
        own = F.pmod(F.xxhash64(member), blocks)
        other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        pair = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))
        out = sized.select("key", *rest, "n", own.alias("i"), other.alias("j")).select(
            F.when(F.col("n").isNull(), F.col("key")).otherwise(pair).alias("key"), *rest
        )
    n = partitions_for(keyed.count(), rows, spark)
    return out.repartition(n, "key")
