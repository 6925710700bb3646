"""Helpers that write the DuckDB reference SQL for the catalog's checks.

The reference SQL is written independently of the Spark code: it spells each
operator's semantics in plain SQL (CASE/contains sums, regexp_extract, windows).
"""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE

WS = "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE)
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    """Python str.strip() in DuckDB."""
    return f"trim({x}, {WS})"


def hits(lowered: str, keywords) -> str:
    terms = [f"(CASE WHEN contains({lowered}, {q(k.lower())}) THEN 1 ELSE 0 END)" for k in keywords]
    return "(" + " + ".join(terms) + ")" if terms else "0"


def section(wikitext: str, name: str) -> str:
    pat = r"(?is)==+\s*" + name + r"\s*==+(.*?)(==+[^=]|$)"
    return strip(f"regexp_extract({wikitext}, {q(pat)}, 1)")
