"""Near-duplicate lines across documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import BATCH_ROWS, CHUNK_BYTES, Scratch, mixed
from .edit import all_within, near_texts
from .graph import components
from .hamming import BROADCAST_ROWS, dealt, majority
from .shards import pack, pack_any, unpack, unpack_any

#: Lines are near duplicates if the edit distance is at most a fifth of the longer one.
SIMILARITY = 0.8
#: Lines that share a block are verified if their fingerprints differ in at most so many
#: of 64 bits: two of 40 words replaced change about 6, one of 8 about 10.
BITS = 20
#: Lines of fewer words have SHORT_PARTS parts of words and a key for each two parts.
#: Longer ones have parts of word pairs: LEAST_PARTS, or the power of PART_STEP that leaves
#: at least PART_PAIRS pairs to a part on average, and a key for each part.
SHORT_WORDS, SHORT_PARTS, LEAST_PARTS, PART_STEP, PART_PAIRS = 16, 5, 8, 2, 4
#: Bits of a key that are compared, lines that are packed at a time, keys of a line and of a range, lines of a range, about.
KEY_BITS, PART_LINES, LINE_KEYS, RANGE_KEYS, RANGE_LINES = 48, 20_000, 16, 500_000, 200_000
#: Rows with texts of a partition, pairs of a block that are judged at a time, bits for the trigrams of a line.
TEXT_ROWS, PAIR_ROWS, GRAM_BITS = 50_000, 1_000_000, 1024
#: Pairs, and characters of their lines together, that go to the edit distance at a time.
PAIRS, PAIR_CHARS = 16_384, 16_000_000
_A = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def normal_lines(text: str) -> list[bytes]:
    """Each line in lower case, runs of ASCII white space as one space; digits stay."""
    data = text.lower().encode()
    if any(space in data for space in (b"  ", b"\t", b"\r", b"\v", b"\f")):
        return [b" ".join(line.split()) for line in data.split(b"\n")]
    return [line.strip(b" ") for line in data.split(b"\n")]


def _words(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each line) of normalised lines that have words."""
    counts = np.fromiter((line.count(b" ") + 1 for line in lines), np.int64, len(lines))
    if not lines:
        return np.zeros(0, np.uint64), counts
    return np.fromiter(map(xxhash.xxh64_intdigest, b" ".join(lines).split(b" ")), np.uint64, int(counts.sum())), counts


def line_fingerprints(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash over the words of each line."""
    return majority(words, np.r_[0, np.cumsum(counts)])


def _parts(features: np.ndarray, line: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, features) of the parts of all lines, line after line.

    A feature is dealt by its hash to one of its line's parts[line] parts; a part is named
    by the sum of its features' hashes.
    """
    use = parts[line] > 0
    features, line = features[use], line[use]
    slot = (np.cumsum(parts) - parts)[line] + (features >> np.uint64(33)).astype(np.int64) % parts[line]
    total, values = int(parts.sum()), mixed(features)
    # Sums of halves: exact as floats below 2 ** 21 features.
    low, high = (np.bincount(slot, (v).astype(float), total).astype(np.uint64) for v in (values & _LOW, values >> np.uint64(32)))
    return low + (high << np.uint64(32)), np.bincount(slot, minlength=total)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Parts of lines of so many words."""
    out = np.full(len(counts), LEAST_PARTS, np.int64)
    while (more := out * PART_STEP * PART_PAIRS <= counts).any():
        out[more] *= PART_STEP
    return out


def line_blocks(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the line, key) of every block of each line, in order of lines.

    Pigeonhole: a replaced word touches two parts of words, or four of word pairs; all
    others stay whole. So lines that differ in one word always share a key, and with more
    changes they do as long as one part (short lines: two parts) is untouched. Lines near
    a step are keyed at both sides of it, so up to a quarter more words is no other step.
    """
    line = np.repeat(np.arange(len(counts)), counts)
    index, keys = [], []
    short = counts < SHORT_WORDS
    name, size = _parts(words, line, np.where(short, SHORT_PARTS, 0))
    name, size = name.reshape(-1, SHORT_PARTS), size.reshape(-1, SHORT_PARTS)
    for k, (i, j) in enumerate(combinations(range(SHORT_PARTS), 2)):
        full = size[:, i] + size[:, j] > 0
        index.append(np.flatnonzero(short)[full])
        keys.append(mixed(name[:, i] * _A + mixed(name[:, j] + np.uint64(k)))[full])
    inner = np.ones(len(words), bool)
    inner[np.cumsum(counts) - 1] = False
    pairs = mixed(words[:-1] * _A + words[1:])[inner[:-1]]
    of_pair = line[inner]
    longer = counts + counts // 4
    own, next_ = _levels(counts), _levels(longer)
    for parts in (np.where(longer >= SHORT_WORDS, own, 0), np.where(next_ != own, next_, 0)):
        name, size = _parts(pairs, of_pair, parts)
        place = np.arange(len(name)) - np.repeat(np.cumsum(parts) - parts, parts)
        full = size > 0
        index.append(np.repeat(np.arange(len(counts)), parts)[full])
        keys.append(mixed(name + mixed((np.repeat(parts, parts) << 32 | place).astype(np.uint64) + _A))[full])
    index, keys = np.concatenate(index), np.concatenate(keys)
    order = np.argsort(index, kind="stable")
    return index[order], keys[order]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, number, lines, size = [], [], [], 0
        for i, text in enumerate(batch.column(2)):
            for k, line in enumerate(normal_lines(text.as_py() or "")):
                if line:
                    at.append(i)
                    number.append(k)
                    lines.append(line)
                    size += len(line)
            if size > CHUNK_BYTES // 4:
                yield _listed(batch, at, number, lines)
                at, number, lines, size = [], [], [], 0
        yield _listed(batch, at, number, lines)


def _listed(batch: pa.RecordBatch, at: list[int], number: list[int], lines: list[bytes]) -> pa.RecordBatch:
    index = pa.array(at, pa.int64())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(index), batch.column(1).take(index), pa.array(number, pa.int32()),
            pa.array(hashes.view(np.int64)), pa.array(lines, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "text_hash", "line", "line_hash", "normal"],
    )


def _ranges(values: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The ranges, by the first bits, that hold any of the ordered values, and where."""
    edges = np.r_[0, np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(values)]
    full = np.flatnonzero(np.diff(edges))
    return full, [slice(edges[i], edges[i + 1]) for i in full]


def _parted(parts: Callable[[list[int], list[bytes]], pa.RecordBatch]):
    """parts() of (line_hash, normal), of PART_LINES lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, size = [], [], 0
        for batch in batches:
            ids.extend(batch.column(0).to_pylist())
            lines.extend(v.encode() for v in batch.column(1).to_pylist())
            size += batch.column(1).nbytes
            if size > 2 * CHUNK_BYTES or len(ids) > PART_LINES:
                yield parts(ids, lines)
                ids, lines, size = [], [], 0
        if ids:
            yield parts(ids, lines)

    return run


def _key_parts(bits: int):
    """Keys of lines: in order, cut into ranges, with the lines that have them."""

    def parts(ids: list[int], lines: list[bytes]) -> pa.RecordBatch:
        ids, first = np.unique(np.array(ids, np.int64), return_index=True)
        line, keys = line_blocks(*_words([lines[i] for i in first]))
        keys &= ~np.uint64((1 << (64 - KEY_BITS)) - 1)
        order = np.argsort(keys)
        keys, held = keys[order], ids[line[order]]
        full, slices = _ranges(keys, bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array([pack(keys[s]) for s in slices], pa.binary()), pa.array([pack_any(held[s]) for s in slices], pa.binary())],
            names=["range", "keys", "ids"],
        )

    return _parted(parts)


def _text_parts(bits: int):
    """Lines in order of their hashes, cut into ranges."""

    def parts(ids: list[int], lines: list[bytes]) -> pa.RecordBatch:
        ids, first = np.unique(np.array(ids, np.int64).view(np.uint64), return_index=True)
        full, slices = _ranges(ids, bits)
        # A normalised line holds no line feed.
        texts = [zstandard.compress(b"\n".join([lines[i] for i in first[s]]), 3) for s in slices]
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array([pack(ids[s]) for s in slices], pa.binary()), pa.array(texts, pa.binary())],
            names=["range", "ids", "texts"],
        )

    return _parted(parts)


def _asked(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(id, fp, size, normal) of the lines of a range that are asked for, once each."""
    wanted = np.unique(asked["id"].to_numpy(np.int64).view(np.uint64))
    ids, lines = [np.empty(0, np.uint64)], []
    for packed, texts in zip(part["ids"], part["texts"]):
        own = unpack(packed)
        held = np.flatnonzero(np.isin(own, wanted, assume_unique=True))
        if len(held):
            some = zstandard.decompress(texts).split(b"\n")
            ids.append(own[held])
            lines.extend(some[i] for i in held)
    ids, first = np.unique(np.concatenate(ids), return_index=True)
    lines = [lines[i] for i in first]
    texts = [line.decode() for line in lines]
    prints = line_fingerprints(*_words(lines))
    size = np.fromiter(map(len, texts), np.int32, len(texts))
    return pd.DataFrame({"id": ids.view(np.int64), "fp": prints.view(np.int64), "size": size, "normal": pd.Series(texts, dtype=object)})


def _shared(part: pd.DataFrame) -> pd.DataFrame:
    """(key, id) of a range of keys, once each, of the keys that two lines or more have."""
    keys = np.concatenate([unpack(k) for k in part["keys"]]).view(np.int64)
    ids = np.concatenate([unpack_any(i) for i in part["ids"]])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    once = first | np.r_[True, ids[1:] != ids[:-1]]
    keys, ids = keys[once], ids[once]
    more = np.r_[False, keys[1:] == keys[:-1], False]
    some = more[1:] | more[:-1]
    return pd.DataFrame({"key": keys[some], "id": ids[some]})


def _most(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that lines of so many characters may differ in."""
    return ((1 - similarity) * np.maximum(a, b) + 1e-9).astype(np.int64)


def _tree(ids: np.ndarray, fps: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between lines of a block, as ids: a forest of pairs whose fingerprints are near and lengths alike."""
    rest, queue = np.arange(1, len(ids)), [0]
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        one = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[one]) <= BITS
        near &= np.abs(sizes[rest] - sizes[one]) <= _most(sizes[rest], sizes[one], similarity)
        found, rest = rest[near], rest[~near]
        queue.extend(found)
        yield np.minimum(ids[found], ids[one]), np.maximum(ids[found], ids[one])


def _linked(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held).sort_values("key", kind="stable")
        key, ids, fps, chars = rows["key"].to_numpy(), rows["id"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= BITS]
        two = two[np.abs(chars[two] - chars[two + 1]) <= _most(chars[two], chars[two + 1], similarity)]
        found = [(np.minimum(ids[two], ids[two + 1]), np.maximum(ids[two], ids[two + 1]))]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            found.extend(_tree(ids[s : s + n], fps[s : s + n], chars[s : s + n], similarity))
        both = np.unique(np.stack([np.concatenate(side) for side in zip(*found)], axis=1), axis=0)
        yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return run


def _verify(similarity: float):
    def near(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        pairs = list(zip(rows["left"].to_pylist(), rows["right"].to_pylist()))
        most = [int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
        return rows.select(["a", "b"]).filter(pa.array(all_within(pairs, most), pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            held.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
            # Few long pairs or many short ones at a time: the more, the more are of like length.
            if size > PAIR_CHARS or rows >= PAIRS:
                yield from near(held).to_batches()
                held, size, rows = [], 0, 0
        if held:
            yield from near(held).to_batches()

    return run


def _gram_bits(texts: pa.Array) -> np.ndarray:
    """A set of GRAM_BITS bits for the character trigrams of each line."""
    out = np.zeros((len(texts), GRAM_BITS // 64), np.uint64)
    for at in range(0, len(texts), BATCH_ROWS):
        some = texts.slice(at, BATCH_ROWS)
        size = pc.utf8_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(some)), size)
        whole = row[2:] == row[:-2]
        gram = mixed(chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:])[whole] % np.uint64(GRAM_BITS)
        held = np.zeros((len(some), GRAM_BITS), bool)
        held[row[2:][whole], gram.astype(np.int64)] = True
        out[at : at + len(some)] = np.packbits(held, axis=1).view(np.uint64)
    return out


def _block_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the two rows of all pairs within blocks, about PAIR_ROWS at a time."""
    for n in np.unique(sizes[sizes > 1]):
        of = starts[sizes == n]
        if n <= 64:
            i, j = np.triu_indices(n, 1)
            step = max(1, PAIR_ROWS // len(i))
            for k in range(0, len(of), step):
                yield (of[k : k + step, None] + i).ravel(), (of[k : k + step, None] + j).ravel()
            continue
        step = max(1, PAIR_ROWS // int(n))
        for s in of:
            for k in range(0, n, step):
                i, j = np.divmod(np.arange(k * n, min(k + step, n) * n), n)
                yield s + i[i < j], s + j[i < j]


def _across(similarity: float):
    """The links between lines of different labels that share a key: all pairs are judged, only links leave.

    Fingerprints, lengths and sets of trigrams (an edit takes away and adds three at most)
    leave few pairs to the edit distance. Labels that a link joined are not compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["key"].to_numpy(), kind="stable")))
        key, ids, of = (rows[c].to_numpy() for c in ("key", "id", "label"))
        fps, chars = rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy().astype(np.int64)
        # A line stands in several blocks: its trigrams are looked for once, when a pair asks for them.
        _, first, line = np.unique(ids, return_index=True, return_inverse=True)
        texts = rows["normal"].combine_chunks().take(pa.array(first))
        grams, known = np.zeros((len(first), GRAM_BITS // 64), np.uint64), np.zeros(len(first), bool)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        labels, of = np.unique(of, return_inverse=True)
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        def links(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            chars_before, k = np.cumsum(chars[i] + chars[j]), 0
            while k < len(i):
                begun = chars_before[k - 1] if k else 0
                stop = min(k + PAIRS, max(k + 1, int(np.searchsorted(chars_before, begun + PAIR_CHARS))))
                some = [(x, y) for x, y in zip(i[k:stop].tolist(), j[k:stop].tolist()) if root(of[x]) != root(of[y])]
                k = stop
                if not some:
                    continue
                x, y = (np.array(side) for side in zip(*some))
                used, places = np.unique(line[np.r_[x, y]], return_inverse=True)
                near = near_texts(texts.take(pa.array(used)).to_pylist(), places[: len(x)], places[len(x) :], _most(chars[x], chars[y], similarity))
                for p, q in zip(x[near].tolist(), y[near].tolist()):
                    p, q = root(of[p]), root(of[q])
                    if p != q:
                        joined[max(p, q)] = min(p, q)
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x[near]]), pa.array(ids[y[near]])], names=["a", "b"])

        left, right, size = [], [], 0
        for i, j in _block_pairs(starts, np.diff(np.r_[starts, len(key)])):
            some = (np.bitwise_count(fps[i] ^ fps[j]) <= BITS) & (of[i] != of[j])
            i, j = i[some], j[some]
            most = _most(chars[i], chars[j], similarity)
            some = np.abs(chars[i] - chars[j]) <= most
            i, j, most = i[some], j[some], most[some]
            asked = np.unique(line[np.r_[i, j]])
            asked = asked[~known[asked]]
            grams[asked], known[asked] = _gram_bits(texts.take(pa.array(asked))), True
            for k in range(0, len(i), PAIR_ROWS // 16):
                x, y = i[k : k + PAIR_ROWS // 16], j[k : k + PAIR_ROWS // 16]
                a, b, limit = grams[line[x]], grams[line[y]], 3 * most[k : k + PAIR_ROWS // 16]
                some = (np.bitwise_count(a & ~b).sum(axis=1) <= limit) & (np.bitwise_count(b & ~a).sum(axis=1) <= limit)
                x, y = x[some], y[some]
                swap = ids[x] > ids[y]
                left.append(np.where(swap, y, x))
                right.append(np.where(swap, x, y))
                size += len(x)
            if size > PAIR_ROWS:
                yield from links(*_once(ids, left, right))
                left, right, size = [], [], 0
        if size:
            yield from links(*_once(ids, left, right))

    return run


def _once(ids: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one for each pair of ids."""
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((ids[j], ids[i]))
    i, j = i[order], j[order]
    new = np.r_[True, (ids[i[1:]] != ids[i[:-1]]) | (ids[j[1:]] != ids[j[:-1]])]
    return i[new], j[new]


def _order() -> Column:
    """Occurrences by document, null ids last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of line hashes that are similar enough, as a written table."""
    sides = [texts.select(F.col("id").alias(c), F.col("normal").alias(n)) for c, n in (("a", "left"), ("b", "right"))]
    return scratch.table(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(similarity), "a long, b long"))


def line_groups(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, groups): every line with words, and for each distinct line that is not alone its kept occurrence.

    lines: doc_id, text_hash, line, line_hash. groups: line_hash, keep.

    1. Equal normalised lines are one (an aggregate). 2. Lines that share a block
    (line_blocks()) and whose fingerprints are near give a spanning forest per block; its
    pairs are verified by edit distance.
    3. What is not connected by then is compared pair by pair, but only between components,
    in the task that holds the block with its texts (_across()); only links leave it.
    So no pair within a group of copies is listed, and no pair that shares a block is left
    out. Keys go packed to the task of their range, which leaves out blocks of one line; lines
    go packed to that of the range of their hashes, which keeps those that share a block.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, line int, line_hash long, normal string"
    split = scratch.table(rows.mapInArrow(_split, schema))
    lines = scratch.table(split.drop("normal"))
    distinct = scratch.table(lines.groupBy("line_hash").agg(F.min(_order()).alias("first"), F.count("*").alias("n")))
    whole = split.select("line_hash", "normal")
    n_lines = lines.count()
    bits, text_bits = (max(6, int(np.ceil(np.log2(max(1, n / size))))) for n, size in ((n_lines * LINE_KEYS, RANGE_KEYS), (n_lines, RANGE_LINES)))
    parts = whole.mapInArrow(_key_parts(bits), "range long, keys binary, ids binary")
    keyed = scratch.table(parts.groupBy("range").applyInPandas(_shared, "key long, id long"))
    needed = keyed.select("id").distinct().withColumn("range", F.shiftrightunsigned("id", 64 - text_bits))
    packed = whole.mapInArrow(_text_parts(text_bits), "range long, ids binary, texts binary")
    texts = packed.groupBy("range").cogroup(needed.groupBy("range"))
    texts = scratch.table(texts.applyInPandas(_asked, "id long, fp long, size int, normal string"))
    scratch.drop(split)
    keyed = scratch.table(keyed.join(texts.select("id", "fp", "size"), "id"))
    pairs = scratch.table(dealt(scratch, keyed, "id").mapInPandas(_linked(similarity), "a long, b long").distinct())
    good = _verified(scratch, pairs, texts, similarity)
    labels = components(scratch, good)
    named = keyed.join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    named = scratch.table(named.select("key", "id", F.coalesce("label", "id").alias("label")))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_ = named.join(apart, "key", "left_semi").join(texts, "id")
    more = scratch.table(dealt(scratch, open_, "id", TEXT_ROWS).mapInArrow(_across(similarity), "a long, b long"))
    scratch.drop(keyed)
    labels = scratch.table(components(scratch, good.union(more)))
    of = distinct.join(labels.select(F.col("node").alias("line_hash"), "label"), "line_hash", "left")
    # Alone: one occurrence of one line.
    some = of.where("n > 1 or label is not null").select("line_hash", "first", F.coalesce("label", "line_hash").alias("label"))
    some = scratch.table(some)
    kept = some.groupBy("label").agg(F.min("first").alias("keep"))
    return lines, scratch.table(some.join(kept, "label").select("line_hash", "keep"))


def deduplicated(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """docs with all columns, near-duplicate lines taken out of the text; n_lines and n_removed follow.

    Lines are split at line feeds and normalised (normal_lines()). Two lines are linked if
    they share a block (line_blocks()), their fingerprints differ in at most BITS bits and
    the edit distance is at most a fifth of the longer line; of each connected group the
    first occurrence by (id, place) stays, wherever it is, and all others go. Lines without words stay and are never
    compared. Null texts stay null and have no lines (n_lines 0). A row that repeats
    another's id and whole text is the same document and gets the same text. Null ids
    come last. No rows give no rows. Extra columns stay as they are; columns named
    n_lines or n_removed are replaced.
    """
    lines, groups = line_groups(scratch, docs, id_col, text_col, similarity)
    gone = lines.select("doc_id", "text_hash", "line", "line_hash").join(groups, "line_hash").where(~_order().eqNullSafe(F.col("keep")))
    listed = scratch.table(
        gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("_gone")).select(F.struct("doc_id", "text_hash").alias("_doc"), "_gone"),
        keep=True,
    )
    size = listed.agg(F.count("*"), F.sum(F.size("_gone"))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 10 * BROADCAST_ROWS
    text = F.col(text_col).cast("string")
    own = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    joined = docs.withColumn("_own", own).join(F.broadcast(listed) if small else listed, F.col("_own").eqNullSafe(F.col("_doc")), "left")
    # A column of its own: inside the loop over kept lines the text would be split once for each of them.
    joined = joined.withColumn("_parts", F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    new = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_parts"), i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("_parts")).cast("long")
    n_removed = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    changed = joined.withColumns({"n_lines": n_lines, "n_removed": n_removed, text_col: new})
    return changed.drop("_own", "_doc", "_gone", "_parts")
