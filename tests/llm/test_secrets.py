import hashlib
import re

from llm_data import table
from syntabula.llm.common import Scratch
from syntabula.llm.secrets import scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex", "opaque")


def base(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in sorted(spans, key=lambda s: s[:2]))


def brute(rows):
    held = []
    for key, text, _, owner in rows:
        own = base(text or "")
        more = [
            (m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or "")
            if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")) and not any(a < m.end() and m.start() < b for a, _, b, _ in own)
        ]
        held.append((key, owner, own, more))
    owners = {}
    for _, owner, own, more in held:
        for s in own + more:
            owners.setdefault(s[3], set()).add(owner)
    out = []
    for key, _, own, more in held:
        all_ = own + [s for s in more if len(owners[s[3]]) == 1]
        counts = [sum(s[1] == k for s in own) for k in range(3)]
        sizes = [len(owners[s[3]]) for s in all_]
        out.append((key, *counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(all_), sum(n == 1 for n in sizes), sum(n >= 3 for n in sizes)))
    return sorted(out, key=str)


def test_equals_python(spark):
    live, copied = "aB3" + "xY7zQ2" * 4, "Zz9" + "EXAMPLEkey0" * 2
    texts = [
        f"password = '{live}' and secret: token: abcdefgh", f"API_KEY=\"{copied}\"", f"see {copied} here", f"x {live}q1 y", "AKIA" + "Q" * 16 + " AKIAB",
        "deadbeef" * 3 + "g" + "ab" * 11, "é漢🙂 passwd:漢 token=ééé secret=abc.def-1", "password=secret:abcdefghij", None, "", "apikey : short api_key=longer1",
        "TOKEN='" + "A1b2" * 9 + "'", "AKIAAKIA" + "B2" * 8, "a" * 23 + " " + "0" * 24, "pAssWord=\nabcdefg", "password" * 5 + "=xxxxxxx", f"{copied} {copied}",
    ]
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "src3"), (None, texts[0], "en", None), (60, copied, None, "src9"), (61, ("word " * 20_000) + copied, "en", "src8")]
    with Scratch(spark) as scratch:
        found = scan(scratch, table(spark, rows), "doc_id", "text", "source", "doc_id").collect()
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"], r["n_live"], r["n_copied"]) for r in found), key=str)
    assert got == brute(rows)
    assert any(r["n_opaque"] for r in found) and any(r["n_copied"] for r in found)


def test_many_matches_and_empty_table(spark):
    rows = [(0, " ".join(f"token=value{i:06d}" for i in range(2000)), "en", "s")]
    with Scratch(spark) as scratch:
        assert scan(scratch, table(spark, rows), "doc_id", "text", "source", "doc_id").first()["n_assign"] == 2000
        assert scan(scratch, table(spark, []), "doc_id", "text", "source", "doc_id").count() == 0
