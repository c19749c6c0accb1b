"""Column expressions for identifiers, attributes and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Chromosome-number patterns, tried in this order.
DESCRIPTION_FIRST = (
    r"(?i)\bchromosome[_ :.-]*(\d+)\b",
    r"(?i)\bchr[_ :.-]*(\d+)\b",
    r"(?:^|[_-])(\d+)$",
    r"(\d+)$",
)
WHOLE_HEADER = (
    r"(?i)chromosome\s*[:=_-]?\s*([0-9]+)",
    r"(?i)\bchr(?:omosome)?[_-]?([0-9]+)\b",
    r"(?i)^chr([0-9]+)$",
)


def nullif_empty(col: Column) -> Column:
    return F.when(col != "", col)


def normalize_id(col: Column) -> Column:
    return F.regexp_replace(F.trim(col), r"^(gene:|transcript:|protein:)", "")


def id_variants(col: Column) -> Column:
    """Candidate spellings of an id, most literal first, without blanks."""
    whole = normalize_id(col)
    parts = F.when(whole.contains("|"), F.split(whole, r"\|")).otherwise(F.array().cast("array<string>"))
    single = F.array(
        whole,
        F.get(F.split(whole, r"\s+"), F.lit(0)),
        F.regexp_replace(whole, r"\.p\d+$", ""),
        F.regexp_replace(whole, r"\.protein\d+$", ""),
        F.regexp_replace(whole, r"\.t\d+$", ""),
    )
    return F.array_distinct(F.filter(F.concat(single, parts), lambda v: v != ""))


def prefix_id(code: Column, col: Column) -> Column:
    clean = normalize_id(col)
    head = F.concat(code, F.lit("_"))
    return F.when(F.startswith(clean, head), clean).otherwise(F.concat(head, clean))


def to_half_open(start: Column) -> Column:
    """1-based closed start to 0-based half-open; the end stays."""
    return start - 1


def to_closed(start: Column) -> Column:
    """0-based half-open start to 1-based closed; the end stays."""
    return start + 1


def natural_key(col: Column) -> Column:
    """Sortable string: digit runs compare as numbers, other text without case.

    A digit run is written behind its own length, so runs of any size compare
    exactly; the separator sorts below printable text.
    """

    def token(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        number = F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
        return F.when(part.rlike("^[0-9]"), number).otherwise(F.lower(part))

    return F.array_join(F.transform(F.regexp_extract_all(col, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), token), "\u0001")


def chromosome_number(seq_id: Column, description: Column | None = None, rule: str = "description_first") -> Column:
    """First number found by the ordered patterns, else NULL."""
    if rule == "whole_header":
        text = F.concat_ws(" ", seq_id, description) if description is not None else seq_id
        tries = [(text, p) for p in WHOLE_HEADER]
    else:
        sources = [seq_id] if description is None else [F.coalesce(description, F.lit("")), seq_id]
        tries = [(source, p) for source in sources for p in DESCRIPTION_FIRST]
    return F.coalesce(*[nullif_empty(F.regexp_extract(s, p, 1)) for s, p in tries]).cast("int")


def classify_repeat(col: Column) -> Column:
    return (
        F.when(col == "LTR/Gypsy", "gypsy")
        .when(col == "LTR/Copia", "copia")
        .when((col == "DNA") | F.startswith(col, F.lit("DNA/")), "dna")
    )


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once; lambdas would repeat it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_attributes(col: Column) -> Column:
    """Map of `key "value"` pairs, then `key=value` pairs whose key is not there yet.

    Of repeated quoted keys the last counts, of repeated `key=value` keys the first.
    """
    # Keys start where a word starts and nothing backtracks: linear in the text.
    quoted = F.lit(r'(?<![A-Za-z0-9_.:-])([A-Za-z0-9_.:-]++)\s++"([^"]*+)"')
    parts = F.filter(F.transform(F.split(F.trim(col), ";"), lambda p: F.trim(p)), lambda p: p.contains("="))

    def of_quoted(group: int) -> Column:
        none = F.when(col.isNotNull(), F.array().cast("array<string>"))
        return F.when(col.contains('"'), F.regexp_extract_all(col, quoted, F.lit(group))).otherwise(none)

    raw = F.struct(
        of_quoted(1).alias("k"),
        of_quoted(2).alias("v"),
        F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1))).alias("pk"),
        F.transform(parts, lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("pv"),
    )

    def later(keys: Column, at: Column) -> Column:
        return F.slice(keys, at + 2, F.size(keys))

    def entries(r: Column) -> Column:
        named = F.zip_with(r["k"], r["v"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        plain = F.zip_with(r["pk"], r["pv"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        last = F.filter(named, lambda e, i: ~F.array_contains(later(r["k"], i), e["key"]))
        first = F.filter(
            plain,
            lambda e, i: ~F.array_contains(r["k"], e["key"]) & ~F.array_contains(F.slice(r["pk"], F.lit(1), i), e["key"]),
        )
        return F.map_from_entries(F.concat(last, first))

    return _bind(raw, entries)


def _first_of(attributes: Column, names: list[str]) -> Column:
    picked = F.coalesce(*[nullif_empty(F.get(F.split(attributes[n], ","), F.lit(0))) for n in names])
    return F.coalesce(normalize_id(picked), F.lit(""))


def transcript_id(attributes: Column, feature: Column) -> Column:
    own = _first_of(attributes, ["transcript_id", "ID"])
    child = _first_of(attributes, ["transcript_id", "Parent", "ID"])
    return F.when(F.lower(feature).isin("mrna", "transcript"), own).otherwise(child)


def gene_id(attributes: Column) -> Column:
    return _first_of(attributes, ["gene_id", "gene", "gene_name", "Parent"])


def ploidy_number(col: Column) -> Column:
    return F.coalesce(nullif_empty(F.regexp_extract(col, r"^(\d+)x$", 1)).cast("int"), F.lit(0))


def ploidy_group(ploidy: Column, is_outgroup: Column) -> Column:
    return F.when(ploidy == "4x", "TETRAPLOID").when(is_outgroup, "OUTGROUP").otherwise("DIPLOID")
