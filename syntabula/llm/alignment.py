"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids meet."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, chunks, mixed
from .shards import small_batches

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k.model"
#: Windows whose alignment a task remembers, and tokens of the longest one it remembers.
MEMO_WINDOWS, MEMO_TOKENS = 200_000, 64
#: Words longer than this go through the tokenizers library, whose merges don't slow down
#: with the square of a word's length.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


def _has_long_run(text: str) -> bool:
    """A run of 2,000 covers a whole block of 1,000, with white space inside it nowhere or everywhere."""
    blocks = (text[k : k + 1000] for k in range(0, len(text) - 999, 1000))
    return any(len(b.split(None, 1)) < 2 for b in blocks) and bool(_LONG_RUN.search(text))


class FirstTokenizer:
    """Byte-level ids of space + text; strings of special tokens are plain text.

    Most texts are encoded from the rank file of the same vocabulary, which takes a quarter
    of the time; both ways give the same ids (tests/llm/test_alignment.py).
    """

    def __init__(self, name: str = FIRST):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = public_tokenizers.path(f"{name}.json"), None
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def ids(self, text: str) -> list[int]:
        if not _has_long_run(text):
            return self.fast.encode_ordinary(" " + text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(" " + text, add_special_tokens=False).ids


class SecondTokenizer:
    """Piece ids of a text, whose model puts a space before it."""

    def __init__(self, name: str = SECOND):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = self.model.get_piece_size()
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.model.id_to_piece(i)) for i in range(n))
        ]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


#: A group with more links than this lists each id pair once, with a number.
_MANY_LINKS = 10_000


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers each, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _distinct(sides: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, place): windows of which all others are copies, and for each window its place in them.

    Copies are looked for by a hash of both sides' ids and compared with the first of their hash,
    so that ids as bytes are cut out once for each; where they differ a window stands for itself.
    """
    hashes, sizes = np.zeros(len(starts[0]), np.uint64), []
    for k, (ids, at) in enumerate(zip(sides, starts)):
        size = np.diff(np.r_[at, len(ids)])
        inside = np.arange(len(ids)) - np.repeat(at, size)
        hashes += np.add.reduceat(mixed((ids << 24) + 2 * inside + k), at)
        sizes.append(size)
    _, once, place = np.unique(hashes, return_index=True, return_inverse=True)
    first = once[place]
    same = np.ones(len(first), bool)
    for ids, at, size in zip(sides, starts, sizes):
        same &= size == size[first]
        same[same] &= np.logical_and.reduceat(_gather(ids, at, size, same) == _gather(ids, at[first], size, same), _firsts(size[same]))
    odd = np.flatnonzero(~same)
    place[odd] = len(once) + np.arange(len(odd))
    return np.r_[once, odd], place


def _firsts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _gather(ids: np.ndarray, at: np.ndarray, size: np.ndarray, use: np.ndarray) -> np.ndarray:
    return ids[_ranges(at[use], size[use])]


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values are among the others; both in order."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


class Windows:
    """Alignments of windows, remembered by both sides' ids.

    A window has a number; texts, n_groups, n_links and the places of its id pairs in keys
    and times stand at it. Windows are numbered as they come and aligned together, shard by shard.
    """

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.sizes = [np.fromiter(map(len, t), np.int64, len(t)) for t in (first, second)]
        # The names of ids, with what follows inside and at the end of a group.
        self.names = [np.array([[f"{i}{c}" for i in range(len(t))] for c in marks], object) for t, marks in ((first, ",|"), (second, ",;"))]
        self.forget(0)

    def forget(self, most: int = MEMO_WINDOWS) -> None:
        """Between shards only: numbers of windows hold within a shard."""
        if not most or len(self.texts) > most:
            self.known: dict[tuple[bytes, bytes], int] = {}
            self.texts: list[str] = []
            self.n_groups, self.n_links, self.first, self.size, self.keys, self.times = (np.empty(0, np.int64) for _ in range(6))

    def numbers(self, sides: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
        """Number of each window between the cuts of both sides."""
        edges = [np.r_[c, len(ids)] for c, ids in zip(cuts, sides)]
        if not len(cuts[0]):
            return np.empty(0, np.int64)
        once, place = _distinct(sides, [e[:-1] for e in edges])
        raw = [ids.astype("<u4").tobytes() for ids in sides]
        spans = ((4 * e[k]).tolist() for e in edges for k in (once, once + 1))
        (ra, rb), (a0, a1, b0, b1) = raw, spans
        keys = [(ra[i:j], rb[k:m]) for i, j, k, m in zip(a0, a1, b0, b1)]
        found, new = list(map(self.known.get, keys)), []
        for i, n in enumerate(found):
            if n is None:
                found[i] = len(self.texts) + len(new)
                new.append(i)
                if len(keys[i][0]) <= 4 * MEMO_TOKENS and len(keys[i][1]) <= 4 * MEMO_TOKENS:
                    self.known[keys[i]] = found[i]
        if new:
            at = once[new]
            self._align(*(ids[_ranges(e[at], e[at + 1] - e[at])] for ids, e in zip(sides, edges)), *(e[at + 1] - e[at] for e in edges))
        return np.array(found, np.int64)[place]

    def _align(self, a: np.ndarray, b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray) -> None:
        """New windows, one after another: their tokens and numbers of tokens on both sides."""
        ends = [np.cumsum(n[ids]) for n, ids in zip(self.sizes, (a, b))]
        shared = ends[0][_among(*ends)]
        group = [np.searchsorted(shared, e) for e in ends]
        na, nb = (np.bincount(g, minlength=len(shared)) for g in group)
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        window = np.repeat(np.arange(len(per_a)), per_a)[first_a]
        # Links: each token of one side with all tokens of its group on the other.
        each = np.where(na * nb > _MANY_LINKS, 0, nb)[group[0]]
        keys = np.repeat(a, each) << 32 | b[_ranges(first_b[group[0]], each)]
        of, times = np.repeat(window[group[0]], each), np.ones(len(keys), np.int64)
        for g in np.flatnonzero(na * nb > _MANY_LINKS):
            (xs, nx), (ys, ny) = (np.unique(t[f[g] : f[g] + n[g]], return_counts=True) for t, f, n in ((a, first_a, na), (b, first_b, nb)))
            keys = np.r_[keys, (xs[:, None] << 32 | ys).ravel()]
            times = np.r_[times, (nx[:, None] * ny).ravel()]
            of = np.r_[of, np.full(len(xs) * len(ys), window[g])]
        order = np.argsort(of, kind="stable")
        size = np.bincount(of, minlength=len(per_a))
        n_links = np.zeros(len(per_a), np.int64)
        np.add.at(n_links, window, na * nb)
        # Names in the order of the text: per group one side, then the other.
        words = np.empty(len(a) + len(b), object)
        for ids, g, mine, n, other, names in ((a, group[0], first_a, na, first_b, self.names[0]), (b, group[1], first_b, nb, first_a + na, self.names[1])):
            last = np.zeros(len(ids), np.int64)
            last[mine + n - 1] = 1
            words[np.arange(len(ids)) + other[g]] = names[last, ids]
        edges = np.r_[0, np.cumsum(per_a + per_b)].tolist()
        listed = words.tolist()
        self.texts += ["".join(listed[x:y]) for x, y in zip(edges, edges[1:])]
        self.n_groups = np.r_[self.n_groups, np.bincount(window, minlength=len(per_a))]
        self.n_links = np.r_[self.n_links, n_links]
        self.first = np.r_[self.first, len(self.keys) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.keys, self.times = np.r_[self.keys, keys[order]], np.r_[self.times, times[order]]


def _blob(*arrays: np.ndarray) -> bytes:
    """Whole numbers of several arrays of one length, compressed."""
    return zstandard.compress(np.stack(arrays).astype("<i8").tobytes(), 1)


def _unblob(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8").reshape(n, -1)


class Aligner:
    """Shards of documents to rows: what is known of each document, and the id pairs it links."""

    def __init__(self, first: str, second: str):
        self.a, self.b = FirstTokenizer(first), SecondTokenizer(second)
        self.windows = Windows(self.a.bytes, self.b.bytes)
        self.flat = [np.frombuffer(b"".join(t.bytes), np.uint8) for t in (self.a, self.b)]
        self.places = [_firsts(sizes) for sizes in self.windows.sizes]
        self.marked = [np.array([t[:1] == b" " for t in x.bytes]) for x in (self.a, self.b)]

    def tokens(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids of each side, numbers of tokens): none for a text whose space and bytes one side does not give back."""
        texts = [t.decode() for t in texts]
        found, kept = [], np.array([t != "" for t in texts], bool)
        whole = np.frombuffer("".join([" " + t for t in texts]).encode(), np.uint8)
        size = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        for tokenizer, flat, sizes in zip((self.a, self.b), self.flat, self.windows.sizes):
            listed = [tokenizer.ids(t) if t else [] for t in texts]
            n = np.fromiter(map(len, listed), np.int64, len(listed))
            ids = np.fromiter(chain.from_iterable(listed), np.int64, int(n.sum()))
            found.append((ids, n))
            given = np.bincount(np.repeat(np.arange(len(n)), n), sizes[ids], len(n)).astype(np.int64)
            kept &= given == size
            # Bytes of the texts whose lengths agree, side by side.
            use = np.repeat(kept, n)
            mine = flat[_ranges(self.places[len(found) - 1][ids[use]], sizes[ids[use]])]
            same = mine == whole[np.repeat(kept, size)]
            if not same.all():
                kept[kept] = np.logical_and.reduceat(same, _firsts(size[kept]))
        return [ids[np.repeat(kept, n)] for ids, n in found], np.stack([n * kept for _, n in found], axis=1)

    def cuts(self, sides: list[np.ndarray]) -> list[np.ndarray]:
        """First token of each window of documents in a row, on both sides.

        Windows start where a token that begins with a space starts on both sides. There
        the tokens before it end on both, so no group reaches over a border.
        """
        starts = [np.cumsum(n[ids]) - n[ids] for n, ids in zip(self.windows.sizes, sides)]
        left, right = (s[m[ids]] for s, m, ids in zip(starts, self.marked, sides))
        borders = left[_among(left, right)]
        return [np.searchsorted(s, borders) for s in starts]

    def row(self, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        self.windows.forget()
        sides, n = self.tokens(texts)
        cuts = self.cuts(sides)
        number = self.windows.numbers(sides, cuts)
        at, listed = cuts[0], number.tolist()
        ends = np.searchsorted(at, np.cumsum(n[:, 0]))
        of = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
        digests = [
            hashlib.sha256("".join(map(self.windows.texts.__getitem__, listed[a:b]))[:-1].encode()).hexdigest() if b > a else ""
            for a, b in zip([0, *ends.tolist()], ends.tolist())
        ]
        # The shard's own numbering: each window once, with its id pairs.
        used, local = np.unique(number, return_inverse=True)
        code, times = np.unique(of * max(1, len(used)) + local, return_counts=True)
        doc, window = np.divmod(code, max(1, len(used)))
        sums = np.stack([self.windows.n_groups[used], self.windows.n_links[used]], axis=1)
        totals = np.zeros((len(texts), 2), np.int64)
        np.add.at(totals, doc, sums[window] * times[:, None])
        size = self.windows.size[used]
        links = _ranges(self.windows.first[used], size)
        keys, pair = np.unique(self.windows.keys[links], return_inverse=True)
        # Documents that hold a pair, each once: windows of a document spread to their pairs.
        first = np.cumsum(size) - size
        once = np.unique(np.repeat(doc, size[window]) * max(1, len(keys)) + pair[_ranges(first[window], size[window])])
        docs = np.bincount(once % max(1, len(keys)), minlength=len(keys))
        longs = lambda v: pa.array([v], pa.list_(pa.int64()))
        cells = [
            longs(ids), *map(longs, (n[:, 0], n[:, 1], totals[:, 0], totals[:, 1])), pa.array([digests], pa.list_(pa.string())),
            longs(keys), longs(docs), pa.array([_blob(doc, window, times)], pa.binary()),
            pa.array([_blob(np.repeat(np.arange(len(used)), size), pair, self.windows.times[links])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cells, names=[c.split(" ")[0] for c in SHARDS.split(", ")])


SHARDS = (
    "ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "pairs array<long>, pair_docs array<long>, windows binary, links binary"
)


def _shards(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                yield aligner.row(batch.column(0).slice(start, len(texts)).to_pylist(), texts)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents: the counts of their links summed over windows, then over documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}
            lists = {c: row[c].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
            n, told = len(lists["ids"]), row["answers"].values
            # In the order of the pairs.
            answers = {c: told.field(c).to_numpy(zero_copy_only=False) if told else np.empty(0, np.int64) for c in ("pair", "count", "best")}
            order = np.argsort(answers["pair"])
            count, best = answers["count"][order], answers["best"][order].astype(np.int64)
            window, pair, times = _unblob(row["links"].as_py(), 3)
            doc, used, repeats = _unblob(row["windows"].as_py(), 3)
            out = []
            for value in (best, count):
                per_window = np.zeros(int(window[-1]) + 1 if len(window) else 0, np.int64)
                np.add.at(per_window, window, times * value[pair])
                per_doc = np.zeros(n, np.int64)
                np.add.at(per_doc, doc, repeats * per_window[used])
                out.append(pa.array(per_doc))
            known = [lists[c] for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*known, *out, lists["digests"]], names=[c.split(" ")[0] for c in RESULT.split(", ")])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs.

    1. Tasks encode whole texts with both tokenizers, cut them into windows at shared ends
    before tokens marked with a space, and align each window once for its ids. About 2 MB of texts
    (or one longer text) become one row: documents as counts of windows, windows as counts
    of id pairs, and each pair once with the number of documents that link it. 2. Numbers of
    documents are summed per pair; the highest of an A id is a window over its pairs, of
    which there are at most as many as B ids. 3. Each shard gets the sums of its own pairs
    back, and sums them over windows and documents. So a link is never a row of a shuffle.

    Null and empty texts, and texts whose bytes the tokens of one side do not give back (a
    literal U+2581), have no tokens: zeros and an empty digest. Each row is a document of its own,
    repeated rows and null ids too. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_shards(first, second), SHARDS)
    # The number of a shard is fixed by writing the table.
    table = scratch.table(made.withColumn("shard", F.monotonically_increasing_id()))
    pairs = table.select("shard", F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).select("shard", "p.pairs", "p.pair_docs").toDF("shard", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(W.partitionBy(F.shiftright("pair", 32)))
    marked = counts.withColumn("best", (F.col("count") == highest).cast("int"))
    answer = F.struct("pair", "count", "best")
    answers = pairs.select("shard", "pair").join(marked, "pair").groupBy("shard").agg(F.collect_list(answer).alias("answers"))
    with small_batches(spark):
        told = table.drop("pairs", "pair_docs").join(answers, "shard", "left").mapInArrow(_sums, RESULT)
        return scratch.table(told, keep=True)
