"""Token alignment against a plain reading of its definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import awkward, table

from syntabula.llm import alignment
from syntabula.llm.alignment import Aligner, FirstTokenizer, align
from syntabula.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")

STRANGE = [
    "naïve café – 漢字かな交じり文 😀🏳️‍🌈", "a▁b", "▁", " lead", "trail  ", "  two   three    four", "\n\n\tx\r\n y", "<s> </s> <|endoftext|> <unk> <0x41>",
    "x" * 5000, " " * 3000 + "y", "=" * 300 + " " + "=" * 77, "ab" * 400, "\x00\x01 ", "don't they're 1234567 3.14", "ﬁ ＡＢＣ  　​", "é é",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return first, second


def plain_groups(libraries, text):
    """[(A ids, B ids)] from the offsets of the whole text; None where there are no tokens."""
    first, second = libraries
    if not text:
        return None
    letters = {chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    decode = {c: ord(c) for c in letters}
    decode |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    bytes_a = [bytes(decode[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None

    def ends(tokens):
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    shared = sorted(set(ends_a) & set(ends_b))
    groups, low = [], 0
    for high in shared:
        groups.append(([i for i, e in zip(a, ends_a) if low < e <= high], [i for i, e in zip(b, ends_b) if low < e <= high]))
        low = high
    return groups


def brute(libraries, rows):
    groups = [plain_groups(libraries, t) for _, t in rows]
    links = [[(x, y) for g in gs or [] for x in g[0] for y in g[1]] for gs in groups]
    count = Counter(p for own in links for p in set(own))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), gs, own in zip(rows, groups, links):
        gs = gs or []
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        n = [sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(own)]
        digest = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out.append((key, *n, sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), digest))
    return sorted(out, key=str)


def test_rows(spark, rows, libraries, monkeypatch):
    documents = [*[r for r in awkward(1) if r[0] not in (104, 105)], *[(300 + i, t) for i, t in enumerate(STRANGE)], (300, STRANGE[0])]
    documents += [(400, " ".join(f"w{i % 97}" for i in range(900)))]
    expected = brute(libraries, documents)
    assert sum(r[1] == 0 for r in expected) >= 5
    with Scratch(spark) as scratch:
        got = align(scratch, table(spark, documents).repartition(4))
    assert got.columns[0] == "doc_id" and rows(got) == expected
    monkeypatch.setattr("syntabula.llm.common.CHUNK_BYTES", 300)
    with Scratch(spark) as scratch:
        assert rows(align(scratch, table(spark, documents))) == expected
        assert align(scratch, table(spark, documents).limit(0)).count() == 0
        assert rows(align(scratch, table(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_windows_never_change_a_group(libraries):
    rng = random.Random(3)
    parts = ["the", " of", "ing", "  ", "\n", "漢", "é", "😀", "1", "==", "'s", " x", "▁", "\t"]
    aligner = Aligner(alignment.FIRST, alignment.SECOND)
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        expected = plain_groups(libraries, text)
        row = aligner.row([1], [text.encode()]).to_pylist()[0]
        assert row["n_groups"] == [len(expected or [])]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in expected or [])
        assert row["digests"] == [hashlib.sha256(shown.encode()).hexdigest() if expected else ""]


def test_forgetting_windows(monkeypatch):
    texts = [f"word{i} of{i}".encode() for i in range(50)]
    one, two = (Aligner(alignment.FIRST, alignment.SECOND) for _ in range(2))
    kept = [one.row([i], [t]).to_pylist() for i, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 3)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 1)
    assert [two.row([i], [t]).to_pylist() for i, t in enumerate(texts)] == kept


def test_first_ids_are_those_of_the_library(libraries):
    rng = random.Random(4)
    texts = [*STRANGE, *("".join(rng.choice(["a", "Z", " ", "\n", "é", "漢", "7", "'ll", "<|endoftext|>"]) for _ in range(60)) for _ in range(500))]
    tokenizer = FirstTokenizer()
    assert [tokenizer.ids(t) for t in texts] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    texts = ["one two three one two four ".encode() * 5, b"two three", b"one"]
    expected = Aligner(alignment.FIRST, alignment.SECOND).row([1, 2, 3], texts).to_pylist()
    # All hashes agree.
    monkeypatch.setattr(alignment, "mixed", lambda v: np.zeros(len(v), np.uint64))
    got = Aligner(alignment.FIRST, alignment.SECOND).row([1, 2, 3], texts).to_pylist()
    for name in ("n_groups", "n_links", "digests", "pairs", "pair_docs"):
        assert got[0][name] == expected[0][name]
