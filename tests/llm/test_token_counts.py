"""Token counts against the library that defines them."""

import random

import pytest
from llm_data import awkward, table

from syntabula.llm.token_counts import Counter, Merges, long_count, ragged_counts, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def counted(library, texts):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def strange(seed, n):
    rng = random.Random(seed)
    alphabets = ["abcdefgh", "aA1 '", " \n\t 　\x85", "äöüßéñ", "漢字かな", "😀🏳️‍🌈", "՘֋₝꟎", "\x00\x1c\x7f", "'s're<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_counts_are_those_of_the_library(library):
    texts = strange(1, 3000)
    texts += ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>\n\n", "x  <|endoftext|>  y", "<|endoftext|", "a" * 700, "aaab" * 300]
    assert Counter().counts(texts) == counted(library, texts)


def test_every_character_in_several_places(library):
    counter = Counter()
    # Every 37th character, and all of the first planes' letters that Unicode tables disagree on.
    points = [c for c in [*range(0, 0x110000, 37), *range(0x500, 0x600), *range(0xA7C0, 0xA800)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}1{chr(c)}2!{chr(c)}!  {chr(c)}x" for c in points]
    assert counter.counts(texts) == counted(library, texts)


def test_long_pre_tokens_merge_as_short_ones(library):
    rng, merges = random.Random(2), Merges()
    for letters in ("ab", "aaaab", "etaoinshrdlu", "0123456789abcdef", "=", "a"):
        for n in (2, 3, 17, 400, 5000):
            word = "".join(rng.choice(letters) for _ in range(n))
            expected = sum(counted(library, [word]))
            parts = [w.encode() for w in merges.pre_tokens(word)]
            assert sum(long_count(w, merges) for w in parts) == expected
            assert ragged_counts(parts, merges).sum() == expected


def test_a_long_text_in_parts(library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " word", "  ", "\n", "7", " 's", "'s", "!", " Zx", "ä"]) for _ in range(60_000))
    expected = counted(library, [text])
    monkeypatch.setattr("syntabula.llm.token_counts.PART_CHARS", 1000)
    assert len(list(Merges().parts(text))) > 50
    assert Counter().counts([text]) == expected


def test_a_very_long_word(library):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert Counter().counts([word]) == counted(library, [word])


def test_rows(spark, rows, library):
    documents = [*awkward(), (200, "x <|endoftext|> y"), (201, "w " * 512), (202, "w " * 600)]
    got = rows(token_counts(table(spark, documents)))
    texts = [t or "" for _, t in documents]
    n = counted(library, texts)
    assert got == sorted([(i, len(t.encode()), k, k > 512) for (i, _), t, k in zip(documents, texts, n)], key=str)
    assert token_counts(table(spark, documents).limit(0)).count() == 0


def test_only_byte_level_files():
    with pytest.raises(ValueError):
        Merges("word_bpe_49k.json")
