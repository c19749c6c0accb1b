"""SQL that gives the rows of the registered queries."""

from __future__ import annotations

from . import rules, strings, words
from .secrets import COPIED_OWNERS, KINDS, LEAST_VALUE, PATTERNS


def _spans(no: int, kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    keep = {
        "assign": f"length(m.value) >= {LEAST_VALUE}",
        "opaque": "regexp_matches(m.value, '[0-9]') AND regexp_matches(m.value, '[a-z]') AND regexp_matches(m.value, '[A-Z]')",
    }.get(kind, "true")
    return f"""
    SELECT doc_id, source, {no} AS no, m.start_at AS s, m.end_at AS e, m.value AS value FROM (
      SELECT doc_id, source, unnest(list_transform(whole, lambda w, i: {{
        'start_at': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda g: length(g))), 0),
        'end_at': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[1:i], lambda g: length(g))), 0),
        'value': vals[i]}})) AS m
      FROM (SELECT doc_id, source, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS whole,
                   regexp_extract_all(t, '{pattern}', {2 if kind == "assign" else 0}) AS vals FROM d)
    ) WHERE {keep}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
SECRETS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_spans(i, k) for i, k in enumerate(KINDS[:3]))}),
opaque AS (SELECT * FROM ({_spans(3, 'opaque')}) o WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
owners AS (SELECT value, count(DISTINCT source) AS n FROM found GROUP BY value),
listed AS (SELECT f.*, n FROM found f JOIN owners USING (value) WHERE no < 3 OR n = 1),
said AS (SELECT *, ({_NAMES})[no + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS w FROM listed)
SELECT d.doc_id,
  count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  sha256(coalesce(string_agg(w, ',' ORDER BY s, no) FILTER (no < 3), '')) AS base_sha256,
  coalesce(string_agg(w, ',' ORDER BY s, no), '') AS spans,
  count(*) FILTER (n = 1) AS n_live, count(*) FILTER (n >= {COPIED_OWNERS}) AS n_copied, count(*) FILTER (no = 3) AS n_opaque
FROM d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id
"""


_W = rules.WORD
_MEASURES = {
    "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
    "upper": "1000 * n_upper // greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    "long_words": "100 * word_chars // greatest(n_words, 1)",
}
_TESTS = " UNION ALL ".join(
    f"SELECT lang, '{r}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM held GROUP BY lang"
    for r, cs in rules.CUTOFFS.items()
    for c in cs
)
_N_TESTS = sum(map(len, rules.CUTOFFS.values()))
_PART = rules.FALSE_REJECTION / len(rules.CUTOFFS)
RULES = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_W}')) AS w, generate_subscripts(regexp_extract_all(t, '{_W}'), 1) AS i FROM d),
windows AS (SELECT doc_id, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS x FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows WHERE x IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) AS r(o) GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_W}') GROUP BY doc_id),
counts AS (SELECT d.doc_id, d.lang, CAST(coalesce(words.n, 0) AS BIGINT) AS n_words, CAST(coalesce(words.c, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
measured AS (SELECT *, {', '.join(f'{e} AS {m}' for m, e in _MEASURES.items())},
  n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM counts),
held AS (SELECT * FROM measured WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({_TESTS}),
probs AS (SELECT lang, rule, cutoff, (SELECT count(DISTINCT coalesce(lang, '')) FROM held) AS strata,
  sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_PART}) + (n - j) * ln(1 - {_PART}))) AS p
  FROM (SELECT *, unnest(range(k + 1)) AS j FROM tests) GROUP BY lang, rule, cutoff),
cuts AS (SELECT lang, {', '.join(f"min(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in rules.CUTOFFS)}
  FROM probs WHERE p <= {rules.ERROR} / {_N_TESTS} / strata GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'coalesce({r} > cut_{r}, false)' for r in rules.CUTOFFS)}) AS kept
FROM measured m LEFT JOIN cuts ON m.lang IS NOT DISTINCT FROM cuts.lang
"""


#: Windows of 35 words that start twice or more, word by word.
WORDS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{rules.WORD}') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + {words.WINDOW - 1}], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - {words.WINDOW - 2})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + o AS p FROM twice, range({words.WINDOW}) AS q(o)),
each_word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY each_word.p) FILTER (gone.p IS NULL) AS kept
  FROM each_word LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Strings of 50 bytes, two hexadecimal digits a byte.
STRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * strings.LENGTH}) AS x
  FROM (SELECT r, doc_id, h, unnest(range(length(h) // 2 - {strings.LENGTH - 1})) AS i FROM d)),
first AS (SELECT x, min(doc_id) AS least FROM strings GROUP BY x),
gone AS (SELECT DISTINCT r, i + o AS p FROM strings JOIN first USING (x), range({strings.LENGTH}) AS q(o) WHERE least < doc_id),
spans AS (SELECT r, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM gone) GROUP BY r),
each_byte AS (SELECT r, substr(h, 2 * p + 1, 2) AS b, p FROM (SELECT r, h, unnest(range(length(h) // 2)) AS p FROM d)),
kept AS (SELECT r, string_agg(b, '' ORDER BY p) AS kept FROM each_byte ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""

NEGATIVES = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
     AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 5
"""
