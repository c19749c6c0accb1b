"""Token counts of whole texts: byte-pair merges applied to many pre-tokens at a time."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import chunks

LIMIT, TOKENIZER = 512, "byte_bpe_50k.json"
#: Pre-tokens of more symbols are merged one by one, rank by rank.
LONG_SYMBOLS = 512
#: Counts of pre-tokens a task remembers, and the longest one it remembers.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
#: A longer text is handled in parts of about so many characters.
PART_CHARS = 1_000_000
#: The start of a word after a word: a pre-token always starts here, whatever stands around it.
_BORDER = re.compile(r"(?<=[0-9A-Za-z]) (?=[A-Za-z])")
#: Up to here the regex module and the tokenizers library agree on letters, digits and
#: white space; later characters may be newer than the Unicode tables of one of them.
_AGREED = "Ԁ"
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(shift)) for b in range(256)]


class Merges:
    """The merge list of a byte-level file of the tokenizers library as arrays."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as lines:
            content = json.load(lines)
        model, before = content["model"], content["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        added = content["added_tokens"]
        if model["type"] != "BPE" or not plain or content["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{tokenizer} is no plain byte-level vocabulary")
        vocabulary = model["vocab"]
        self.bytes = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.left, self.right, self.merged = (
            np.array(column, np.int64) for column in zip(*((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]))
        )
        # Each token has one merge, listed after those of its parts: a merge never makes a
        # pair of lower rank, so all places of the lowest pair may be merged at once.
        place = np.full(max(vocabulary.values()) + 1, -1)
        place[self.merged] = np.arange(len(self.merged))
        if len(np.unique(self.merged)) < len(self.merged) or (np.maximum(place[self.left], place[self.right]) >= np.arange(len(self.merged))).any():
            raise ValueError(f"{tokenizer} lists a merge before one of its parts")
        self.width = len(place)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        specials = [re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))]
        self.special = re.compile("|".join(specials)) if specials else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.pre_tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer)).pre_tokenizer

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge list, _NONE for those that never merge."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NONE)

    def pre_tokens(self, text: str) -> list[str]:
        if not text or max(text) < _AGREED:
            return self.words.findall(text)
        return [text[i:j] for _, (i, j) in self.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about PART_CHARS that have the pre-tokens of the whole."""
        start = 0
        while len(text) - start > PART_CHARS and (border := _BORDER.search(text, start + PART_CHARS)):
            yield text[start : border.start()]
            start = border.start()
        yield text[start:]


def _every_other(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places that overlap (each follows the one before), the first, third and so on of each run."""
    starts = np.flatnonzero(~follows)
    inside = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return at[inside % 2 == 0]


def ragged_counts(words: list[bytes], merges: Merges) -> np.ndarray:
    """Surviving symbols of each non-empty pre-token.

    All pre-tokens stand in one array of symbols. A round takes from each its pair of lowest
    rank, merges all places of that pair from left to right, and closes the gaps. Pre-tokens
    without a pair that merges leave the array.
    """
    out = np.zeros(len(words), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), sizes)
    # Rank of a symbol with its right neighbour; the last of a pre-token has none.
    ranks = np.full(len(symbols), _NONE, np.int64)
    stale = np.flatnonzero(of[1:] == of[:-1])
    while len(symbols):
        ranks[stale] = merges.ranks(symbols[stale], symbols[stale + 1])
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        lengths = np.diff(np.r_[starts, len(of)])
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == _NONE
        out[of[starts[done]]] = lengths[done]
        hits = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks < _NONE))
        hits = _every_other(hits, np.r_[False, np.diff(hits) == 1][: len(hits)])
        symbols[hits] = merges.merged[ranks[hits]]
        fresh = np.zeros(len(symbols), bool)
        fresh[hits] = True
        stay = np.repeat(~done, lengths)
        stay[hits + 1] = False
        symbols, of, ranks, fresh = symbols[stay], of[stay], ranks[stay], fresh[stay]
        inner = np.r_[of[1:] == of[:-1], False][: len(of)]
        ranks[~inner] = _NONE
        stale = np.flatnonzero(inner & (fresh | np.r_[fresh[1:], False][: len(fresh)]))
    return out


def long_count(word: bytes, merges: Merges) -> int:
    """Surviving symbols of one long pre-token: places of each pair wait under its rank, lowest first.

    A rank's places are merged together, so the work grows with the length and with the
    number of ranks, not with their product.
    """
    n = len(word)
    symbols = merges.bytes[np.frombuffer(word, np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(at: np.ndarray) -> None:
        ranks = merges.ranks(symbols[at], symbols[after[at]])
        at, ranks = at[ranks < _NONE], ranks[ranks < _NONE]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for places, rank in zip(np.split(at, cuts), ranks[np.r_[0, cuts]].tolist() if len(at) else []):
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(heap, rank)
            waiting[rank].append(places)

    wait(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[(symbols[at] == merges.left[rank]) & (after[at] < n)]
        at = at[symbols[after[at]] == merges.right[rank]]
        at = _every_other(at, np.r_[False, at[1:] == after[at[:-1]]][: len(at)])
        if not len(at):
            continue
        gone = after[at]
        symbols[at], symbols[gone] = merges.merged[rank], -1
        after[at] = after[gone]
        inner = at[after[at] < n]
        before[after[inner]] = inner
        wait(np.unique(np.r_[before[at[before[at] >= 0]], inner]))
    return int((symbols >= 0).sum())


class Counter:
    """Token counts of texts; counts of short pre-tokens are remembered."""

    def __init__(self, tokenizer: str = TOKENIZER):
        self.merges, self.memo = Merges(tokenizer), {}

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        short = [w for w in words if w not in self.memo and len(w) <= MEMO_CHARS]
        for first in range(0, len(short), 50_000):
            part = short[first : first + 50_000]
            self.memo.update(zip(part, ragged_counts([w.encode() for w in part], self.merges).tolist()))

    def count_words(self, words: list[str]) -> int:
        """Tokens of pre-tokens; the short ones must have been learned."""
        total, odd = 0, []
        for word in words:
            known = self.memo.get(word)
            if known is None:
                odd.append(word.encode())
            else:
                total += known
        brief = [w for w in odd if len(w) <= LONG_SYMBOLS]
        total += int(ragged_counts(brief, self.merges).sum()) if brief else 0
        return total + sum(long_count(w, self.merges) for w in odd if len(w) > LONG_SYMBOLS)

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            self.learn(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i] += self.count_words(words)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            special = self.merges.special
            out.append(len(special.findall(text)) if special else 0)
            for piece in special.split(text) if out[i] else [text]:
                for part in self.merges.parts(piece):
                    held.append((i, self.merges.pre_tokens(part)))
                    size += len(part)
                    if size > PART_CHARS:
                        settle()
        settle()
        return out


def _count(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in chunks(batch.column(1)):
                n_bytes += map(len, texts)
                n_tokens += counter.counts([t.decode() for t in texts])
            tokens = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs, without a shuffle.

    Counts are those of the tokenizers library without added tokens; strings of special
    tokens inside a text are one token each, as by its default. Whole texts are counted,
    without truncation. Null and empty texts have 0 bytes and tokens. Repeated rows and rows
    without an id give a row each. No rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(_count(tokenizer, limit), schema)
