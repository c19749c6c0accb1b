"""Column expressions over sequence letters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One-letter codes.
NUCLEOTIDE_CODES = "ACGTUNRYKMSWBDHV"
AMINO_ONLY_CODES = "EFILPQZ"
PROTEIN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*.-"
CDS_ALPHABET = "ACGTNRYKMSWBDHV"


def both_cases(letters: str) -> str:
    return letters.upper() + letters.lower()


def count_letters(seq: Column, letters: str) -> Column:
    """How many characters of seq are in letters (both cases)."""
    return F.length(seq) - F.length(F.translate(seq, both_cases(letters), ""))


def gc_fraction(seq: Column) -> Column:
    """(G+C)/(A+C+G+T); other letters are left out, NULL when none remain."""
    return F.try_divide(count_letters(seq, "GC"), count_letters(seq, "ACGT"))


def n_runs(seq: Column) -> Column:
    """Array of runs of N."""
    return F.regexp_extract_all(seq, F.lit("[Nn]+"), F.lit(0))


def contigs(seq: Column) -> Column:
    """Array of the non-empty pieces between runs of N."""
    return F.filter(F.split(seq, "[Nn]+"), lambda piece: F.length(piece) > 0)


def sequence_type(seq: Column, letters: int = 100_000) -> Column:
    """Struct (type, fraction) judged on the first `letters` letters.

    The letter limit is part of the rule, not a shortcut: the same limit decides
    the published type.
    """
    head = F.substring(F.regexp_replace(seq, "[^A-Za-z]", ""), 1, letters)
    total = F.length(head)
    nucleotide = F.try_divide(count_letters(head, NUCLEOTIDE_CODES), total)
    amino = F.try_divide(count_letters(head, AMINO_ONLY_CODES), total)
    return F.struct(
        F.when(total == 0, "EMPTY")
        .when((nucleotide >= 0.95) & (amino <= 0.01), "NUCLEOTIDE")
        .otherwise("PROTEIN_OR_NONNUCLEOTIDE")
        .alias("type"),
        F.coalesce(nucleotide, F.lit(0.0)).alias("fraction"),
    )


def clean_sequence(seq: Column, kind: str = "protein", stops: str = "trailing") -> Column:
    """Struct (sequence, issue): upper case; proteins lose stop signs, CDS read U as T.

    stops is "trailing" or "all". issue is EMPTY, INVALID_LETTERS or NULL.
    """
    upper = F.upper(seq)
    if kind == "cds":
        cut = F.translate(upper, "U", "T")
        alphabet = CDS_ALPHABET
    else:
        cut = F.regexp_replace(upper, r"\*+$" if stops == "trailing" else r"\*", "")
        alphabet = PROTEIN_ALPHABET
    issue = F.when(cut == "", "EMPTY").when(~cut.rlike(f"^[{alphabet}]+$"), "INVALID_LETTERS")
    return F.struct(cut.alias("sequence"), issue.alias("issue"))


def wrap_sequence(seq: Column, width: int = 60) -> Column:
    """Line-wrapped sequence without a trailing newline."""
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})", "$1\n")
    return F.regexp_replace(wrapped, "\n$", "")
