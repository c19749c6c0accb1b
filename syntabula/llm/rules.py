"""Quality rules whose cutoffs come with a bound on good documents rejected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Candidate cutoffs; a rule rejects a document whose measure is above its cutoff.
#: Measures are whole numbers: per 1000 word characters, lines or words; long_words is
#: 100 times the mean length.
CUTOFFS = {
    "symbols": (5, 10, 20, 50, 100, 200),
    "upper": (50, 100, 200, 300, 500, 700),
    "dup_lines": (50, 100, 200, 300, 500, 700),
    "repeats": (50, 100, 200, 300, 400, 450),
    "long_words": (700, 800, 1000, 1200, 1500, 2000),
}
#: At most this share of a stratum's good documents is rejected by all rules together,
#: in every stratum at once with this probability of error.
FALSE_REJECTION, ERROR = 0.05, 0.05
#: Strata of which the table of cutoffs (one short row each) is broadcast; more are shuffled.
BROADCAST_ROWS = 10_000


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more (compared by 64-bit hash)."""
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        starts, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    )

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: F.get(ordered, j)["h"].eqNullSafe(x["h"])
        found = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    # The one-element array binds the sorted windows, so that they are sorted once.
    at = F.get(F.transform(F.array(F.sort_array(windows)), repeated), F.lit(0))
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"))
    return F.aggregate(at, first, step, lambda s: s["n"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, base counts and whole-number measures of every whole text; null is empty."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"), text_of(text_col).alias("_text"))
    split = rows.withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
        }
    )
    counts = split.select(
        "doc_id",
        "stratum",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    share = lambda part, whole, by=1000: F.expr(f"({by} * {part}) div greatest({whole}, 1)")
    return counts.select(
        "*",
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_upper", "word_chars").alias("upper"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("word_chars", "n_words", 100).alias("long_words"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps up; relative error below 1e-14 for x >= 1."""
    y = x + 8
    up = sum((F.log(x + i) for i in range(8)), F.lit(0.0))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - up


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p).

    The probability of k, then downwards by the ratio of neighbours. Terms more than
    40 standard-deviation bounds (sqrt n) below k are less than exp(-1000) of the sum
    for k below the mean, which is the only case that can pass a test.
    """
    k, n = k.cast("double"), n.cast("double")
    log_choose = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
    top = log_choose + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(40 * F.sqrt(n)) + 40).cast("int")
    step = lambda s, j: F.struct(
        (s["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("term"),
        (s["sum"] + s["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("sum"),
    )
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.exp(top) * F.aggregate(steps, first, step, lambda s: s["sum"]))


def select_cutoffs(scratch: Scratch, measured: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """One row per stratum: for each rule its lowest safe cutoff, or null.

    The holdout is every labelled good document that passes the base rules; cutoffs are
    fixed beforehand, so no label takes part in choosing them. Each rule gets an equal
    part of false_rejection. A cutoff is safe if an exact binomial test rejects "more
    than that part of good documents lie above it" at error / (strata x rules x cutoffs)
    (Bonferroni), which is the same as an upper Clopper-Pearson bound below that part.
    Counts are sums per stratum and combine map-side.
    """
    tried = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_good"))
    held = measured.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_good"), "left_semi")
    above = scratch.table(
        held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r, c in tried])
    )
    part = false_rejection / len(CUTOFFS)
    level = error / len(tried) / max(1, above.count())
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r, c in tried]))
    tests = above.select("stratum", "n", each.alias("t")).select("stratum", "n", "t.*")
    passed = binomial_cdf(F.col("k"), F.col("n"), part) <= level
    return tests.groupBy("stratum").agg(
        *[F.min(F.when((F.col("rule") == r) & passed, F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS]
    )


def controlled(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang"
) -> DataFrame:
    """Base counts and verdict of every row of docs.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. kept is false if a base rule fails or a measure is above the
    cutoff of its stratum. A stratum without enough labelled documents (or none, or an
    empty labels table) has no cutoff and rejects by the base rules alone; null is a
    stratum of its own. Null texts are empty and fail the base rules. Repeated rows get
    a row each; a document labelled twice is good if all its labels say so, and null
    labels are not good. Other columns are not read.
    """
    measured = scratch.table(measures(docs, id_col, text_col, stratum), keep=True)
    cuts = scratch.table(select_cutoffs(scratch, measured, labels).withColumnRenamed("stratum", "_stratum"), keep=True)
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    judged = measured.join(side, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.lit(False)
    for r in CUTOFFS:
        failed = failed | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"),
    )
