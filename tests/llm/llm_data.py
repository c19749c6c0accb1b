"""Small documents with every awkward case, and their columns under clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        *[T.StructField(c, T.StringType()) for c in ("fp", "key", "shard", "label", "line", "n", "first", "owner", "stratum", "value", "id")],
    ]
)


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        key, text, lang, source = (*r, "en", "src0")[:4] if len(r) == 2 else r
        full.append((key, text, lang, source, None if text is None else len(text), *["x"] * 11))
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed, n=40, words="a bb ccc dd e ff ggg hh".split(), length=(0, 60)):
    """Texts over few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            own = rng.choice(texts).split(" ")
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        elif texts and kind < 0.6:
            other = rng.choice(texts).split(" ")
            texts.append(" ".join([rng.choice(words) for _ in range(10)] + other + [rng.choice(words) for _ in range(5)]))
        else:
            gap = lambda: rng.choice([" ", " ", " ", "\n", "\t "])
            texts.append("".join(rng.choice(words) + gap() for _ in range(rng.randint(*length))))
    return texts


def awkward(seed=0):
    """(doc_id, text): a corpus, then null and empty texts, white space, other scripts, repeated rows, null ids, a long text."""
    texts = corpus(seed)
    rows = list(enumerate(texts))
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "é ü 漢字  x"), (104, long), (105, long + " end"), (106, "z " * 400)]
    rows += [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None), (7, texts[9])]
    return rows
