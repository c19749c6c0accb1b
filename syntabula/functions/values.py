"""Column expressions that read numbers and lists out of text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def classify_number(col: Column) -> Column:
    """Struct (class, value, negative) of a text cell."""
    text = F.trim(F.coalesce(col, F.lit("")))
    # try_cast knows the spellings NaN and Infinity; the rest is matched by pattern.
    nan = text.rlike("(?i)^[+-]?nan$")
    infinite = text.rlike("(?i)^[+-]?inf(inity)?$")
    plain = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    number = F.when(plain, text.try_cast("double"))
    huge = number.isNotNull() & (F.abs(number) == float("inf"))
    kind = (
        F.when(text == "", "missing")
        .when(nan, "nan")
        .when(infinite | huge, "infinite")
        .when(plain, "finite")
        .otherwise("nonnumeric")
    )
    value = F.when(kind == "finite", number)
    return F.struct(
        kind.alias("class"), value.alias("value"), F.coalesce(value < -1e-12, F.lit(False)).alias("negative")
    )


def parse_value_list(col: Column, sep: str = "_") -> Column:
    """Array of the finite numbers in a joined list; values within 1e-12 of zero become 0."""
    tokens = F.filter(F.split(F.trim(col), f"[{sep}]"), lambda t: t != "")
    numbers = F.filter(
        F.transform(tokens, lambda t: t.try_cast("double")),
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")),
    )
    return F.transform(numbers, lambda v: F.when(F.abs(v) <= 1e-12, 0.0).otherwise(v))


#: An item of a literal list: a quoted text, in which a backslash stands before any character,
#: or a whole number. The repeats give nothing back, so long cells need no deep stack.
_ITEM = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?(?:0|[1-9][0-9]*+)"""
_MARK = "\x01"


def _literal_items(inner: Column) -> tuple[Column, Column]:
    """(whether the inside of brackets is a list of literal items, those items)."""
    # Every item as a mark: what is left of a list is marks with a comma between them.
    marked = F.regexp_replace(F.regexp_replace(F.replace(inner, F.lit(_MARK), F.lit("?")), _ITEM, _MARK), r"\s+", "")
    rest = F.replace(F.concat(marked, F.lit(",")), F.lit(_MARK + ","), F.lit(""))
    is_list = (rest == "") | ((rest == ",") & (F.endswith(marked, F.lit(_MARK + ",")) | (marked == "")))
    items = F.regexp_extract_all(inner, F.lit(_ITEM), F.lit(0))
    quoted = lambda t: F.startswith(t, F.lit("'")) | F.startswith(t, F.lit('"'))
    bare = lambda t: F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\\(.)", "$1")
    return is_list, F.transform(items, lambda t: F.trim(F.when(quoted(t), bare(t)).otherwise(t)))


def parse_gene_list(col: Column, list_sep: str = r"[\s,;|]+") -> Column:
    """Array of ids of a list cell; blanks and NA give an empty one.

    A cell in brackets whose items are quoted, or whole numbers, with commas between them
    is read as that literal list first: blanks, separators and brackets within quotes belong
    to the id. Any other cell is split at list_sep, brackets and quotes dropped. list_sep is
    explicit because ids may hold `_` themselves. Empty ids are left out.
    """
    text = F.trim(F.coalesce(col, F.lit("")))
    bracketed = (F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))) | (F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")))
    is_list, literal = _literal_items(F.substring(text, F.lit(2), F.length(text) - 2))
    bare = F.regexp_replace(text, r"^[\[\]()]+|[\[\]()]+$", "")
    items = F.transform(F.split(bare, list_sep), lambda t: F.regexp_replace(F.trim(t), "^['\"]+|['\"]+$", ""))
    empty = F.array().cast("array<string>")
    return F.when(F.lower(text).isin("", "nan", "none", "na"), empty).otherwise(
        F.filter(F.when(bracketed & is_list, literal).otherwise(items), lambda t: t != "")
    )
