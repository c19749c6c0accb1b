import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_data import awkward, table
from syntabula.llm.common import Scratch
from syntabula.llm.packing import SIZE, SPECIAL, Encoder, pack, patterns, slots


def odd_texts():
    return ["", "a", f"x {SPECIAL} y", "é ü 漢字 🙂", "b" * 3000, " " * 2500 + "x", "\n\n\t tab", "don't WE'LL 1234 $%&"]


def test_ids_equal_the_tokenizers_library():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = Encoder()
    for text in odd_texts() + [t for _, t in awkward(1) if t]:
        assert encoder.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pieces_are_whole_and_packed(spark):
    rows = awkward(4) + [(500 + i, t) for i, t in enumerate(odd_texts())] + [(600 + i, "same text") for i in range(300)]
    with Scratch(spark) as scratch:
        got = pack(scratch, table(spark, rows)).collect()
    encoder = Encoder()
    want = Counter()
    for key, text in rows:
        ids = np.append(encoder.ids(text or ""), 0).astype("<u4")
        for a in range(0, len(ids), SIZE):
            part = ids[a : a + SIZE]
            want[key, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= SIZE
        padding += 0 if at & (at - 1) == 0 else SIZE - at
    assert padding <= SIZE


def test_patterns_use_every_length_once():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, SIZE + 1, 20_000), np.full(1000, 400), np.ones(5000, int), np.minimum(SIZE, rng.lognormal(5, 1, 20_000).astype(int) + 1)):
        packs = patterns(dict(Counter(lengths.tolist())))
        used = Counter()
        for pack_, count in packs:
            assert sum(pack_) <= SIZE
            for x in pack_:
                used[x] += count
        assert used == Counter(lengths.tolist())
        # Every rank of a length has its place.
        for length, (first, _, _) in slots(packs).items():
            assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < used[length]
    assert patterns({}) == []


def test_empty_table(spark):
    with Scratch(spark) as scratch:
        assert pack(scratch, table(spark, [])).count() == 0
