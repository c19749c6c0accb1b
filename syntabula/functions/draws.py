"""Random numbers that are functions of a counter, as expressions that SQL repeats exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WORD = 1 << 32
# Multipliers of a public 32-bit finaliser, and an odd step near WORD / golden ratio.
FIRST, SECOND, STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1
#: A number's draws come one by one up to this count, beyond it from a normal distribution.
SINGLY = 16
#: Uniform numbers whose sum, less half their number, stands for a normal one.
UNIFORMS = 12


def poisson_steps(most: int = 12) -> list[int]:
    """A 32-bit number at or above k of these steps stands for k events of a Poisson variable of mean 1."""
    share, total, steps = math.exp(-1.0), 0.0, []
    for k in range(most + 1):
        total += share
        steps.append(int(total * WORD))
        share /= k + 1
    return steps


def _times(h: Column, factor: int) -> Column:
    """h * factor mod 2^32 without leaving 64 bits."""
    return (F.shiftright(h, 16) * F.lit(factor) % 65536 * 65536 + h.bitwiseAND(F.lit(65535)) * F.lit(factor)) % F.lit(WORD)


_STEPS = (
    lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
    lambda h: _times(h, FIRST),
    lambda h: h.bitwiseXOR(F.shiftright(h, 13)),
    lambda h: _times(h, SECOND),
    lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
)


def mix(h: Column) -> Column:
    """Bijective mix of a number below 2^32. Each step uses its number twice, hence the lambdas."""
    for step in _STEPS:
        h = F.get(F.transform(F.array(h), step), F.lit(0))
    return h


def key_words(*parts: Column) -> tuple[Column, Column]:
    """Two numbers below 2^32 from the text of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def uniform(words: tuple[Column, Column], counter: Column) -> Column:
    """Number below 2^32 of a key at a counter."""
    return mix(mix((words[0] + counter * F.lit(STEP)) % F.lit(WORD)).bitwiseXOR(words[1]))


def with_uniform(df: DataFrame, name: str, words: tuple[Column, Column], counter: Column) -> DataFrame:
    """df with the column uniform(words, counter), made step by step: compiled code instead of lambdas."""
    df = df.withColumn(name, (words[0] + counter * F.lit(STEP)) % F.lit(WORD))
    for step in (*_STEPS, lambda h: h.bitwiseXOR(words[1]), *_STEPS):
        df = df.withColumn(name, step(F.col(name)))
    return df


def poisson_one(number: Column) -> Column:
    """Events of a Poisson variable of mean 1."""
    return sum(((number >= step).cast("long") for step in poisson_steps()), F.lit(0).cast("long"))


def mix_sql(h: str) -> str:
    """The expression of mix() in SQL, as nested selects over one column."""
    times = lambda c, f: f"(((({c}) >> 16) * {f}) % 65536 * 65536 + (({c}) & 65535) * {f}) % {WORD}"
    return f"""list_transform(list_transform(list_transform([{h}], lambda h: {times("xor(h, h >> 16)", FIRST)}),
      lambda h: {times("xor(h, h >> 13)", SECOND)}), lambda h: xor(h, h >> 16))[1]"""
