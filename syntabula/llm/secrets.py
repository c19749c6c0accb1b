"""Secrets in whole texts, judged by how many owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, text_of

#: Kinds in the order in which equal starts are listed. A match must have at least
#: `least` characters, counted in group 2 for an assignment, in the whole match otherwise.
#: A whole-match minimum is part of the pattern: shorter runs can't hold a longer match.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = ("assign", "access", "hex", "opaque")
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    # Added by the method: opaque runs without a keyword, if only one owner has the value.
    "opaque": r"[A-Za-z0-9+/_-]{20,}",
}
LEAST_VALUE = 6
#: A value of this many owners or more is a copied example; a value of one owner is live-looking.
COPIED_OWNERS = 3


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, no, end, value): leftmost non-overlapping matches, in code points."""
    pattern = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        value.alias("value"),
    )
    entry = "struct<start:int,no:int,end:int,value:string>"
    none = F.array().cast(f"array<{entry}>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["size"]
        found = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("no"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["all"], found.cast(entry)).alias("all"))

    start = F.struct(F.lit(0).alias("at"), none.alias("all"))
    listed = F.aggregate(parts, start, step, lambda s: s["all"])
    if kind == "assign":
        listed = F.filter(listed, lambda m: F.length(m["value"]) >= LEAST_VALUE)
    if kind == "opaque":
        classes = ("[0-9]", "[a-z]", "[A-Z]")
        listed = F.filter(listed, lambda m: m["value"].rlike(classes[0]) & m["value"].rlike(classes[1]) & m["value"].rlike(classes[2]))
    return F.when(text.rlike(pattern), listed).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda m: F.struct(m["start"], m["no"], m["end"])))
    said = F.transform(ordered, lambda m: F.concat_ws(":", F.get(names, m["no"]), m["start"].cast("string"), m["end"].cast("string")))
    return F.concat_ws(",", said)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["no"] == KINDS.index(kind))).cast("long")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories) over the whole corpus.

    Counted in steps (value, owner, repository), (value, owner), (value), each combined
    map-side, so that a value that a third of the rows hold is never gathered. A
    repository belongs to an owner; a null owner or repository counts as one.
    """
    return (
        candidates.groupBy("value_hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("value_hash")
        .agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    )


def scan(
    scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, owner: str, repository: str, copied_owners: int = COPIED_OWNERS
) -> DataFrame:
    """Secrets of every row of docs.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    n_opaque. Spans are kind:start:end in code points, end exclusive, by start, then
    kind. The three base kinds always stay; an opaque run of 20 or more characters with
    a digit and both cases, outside the base spans, is added if its value has exactly one
    owner in the corpus. n_live counts listed spans whose value has one owner, n_copied
    those with copied_owners or more. A null text is empty: no spans. Repeated rows are
    scanned each; a null id, owner or repository is a value like others. No rows give no
    rows. Only the named columns are read, so extra columns can't clash.
    """
    text = F.col("_text")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), text_of(text_col).alias("_text")
    )
    base = F.concat(*[_matches(text, k) for k in KINDS[:3]])
    found = rows.select("doc_id", "owner", "repository", base.alias("base"), _matches(text, "opaque").alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # The row number is fixed by writing the table; ids may repeat or be null.
    found = scratch.table(
        found.withColumn("more", apart).withColumn("row", F.monotonically_increasing_id()), keep=True
    )
    each = found.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("m")).select(
        "row", "owner", "repository", "m.start", "m.no", "m.end", F.sha2(F.col("m.value").cast("binary"), 256).alias("value_hash")
    )
    held = ownership(each)
    opaque = F.col("no") == KINDS.index("opaque")
    judged = each.join(held, "value_hash").where(~opaque | (F.col("n_owners") == 1))
    listed = scratch.table(
        judged.groupBy("row").agg(
            F.collect_list(F.struct("start", "no", "end")).alias("all"),
            F.count_if(F.col("n_owners") == 1).alias("n_live"),
            F.count_if(F.col("n_owners") >= copied_owners).alias("n_copied"),
            F.count_if(opaque).alias("n_opaque"),
        ),
        keep=True,
    )
    zero = F.lit(0).cast("long")
    return found.join(listed, "row", "left").select(
        "doc_id",
        *[_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_copied", "n_opaque")],
    )
