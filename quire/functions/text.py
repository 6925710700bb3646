"""Text scalars as Spark column expressions.

All of these stay inside whole-stage codegen except the lambda forms noted below.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, functions as F

# Python's str.strip() removes every character for which str.isspace() is true.
# The set is derived from that rule (all such code points lie below U+3001).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims Unicode whitespace on both ends (Spark ``trim``
    alone trims only spaces)."""
    return F.trim(as_col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when null, empty or whitespace only."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def head(c, n: int) -> Column:
    """First ``n`` characters (code points), like ``s[:n]``."""
    return F.substring(as_col(c), 1, n)


def ellipsis(c, n: int = 100, suffix: str = "...") -> Column:
    """``s[:n] + '...'`` when longer than ``n``; shorter values and nulls unchanged."""
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def title_word(c) -> Column:
    """``str.title()`` for single-word names (section names)."""
    return F.initcap(as_col(c))


def first_non_blank(primary, fallback) -> Column:
    """``primary if primary.strip() else fallback`` (nulls read as '')."""
    p = F.coalesce(as_col(primary), F.lit(""))
    return F.when(F.length(py_strip(p)) > 0, p).otherwise(F.coalesce(as_col(fallback), F.lit("")))


def strip_prefix_all(c, prefix: str) -> Column:
    """``s.replace(prefix, '')`` — removes every occurrence."""
    return F.replace(as_col(c), F.lit(prefix), F.lit(""))


def keyword_hits(lowered_text, keywords: Iterable[str], method: str = "filter") -> Column:
    """Number of list entries that occur as a case-insensitive substring.

    ``lowered_text`` must already be lower-cased (compute ``lower(text)`` once
    per row and pass the column).  Entries are counted once each, not per
    occurrence, and overlapping entries each count ("trek" and "trekking").

    method="filter": one ``filter`` over a literal array (one lambda per row).
    method="sum": a sum of ``contains`` tests (fully code-generated).
    """
    kws = [k.lower() for k in keywords]
    t = as_col(lowered_text)
    if not kws:
        return F.lit(0)
    if method == "sum":
        expr = None
        for k in kws:
            term = F.contains(t, F.lit(k)).cast("int")
            expr = term if expr is None else expr + term
        return F.coalesce(expr, F.lit(0))
    arr = F.array(*[F.lit(k) for k in kws])
    return F.coalesce(F.size(F.filter(arr, lambda k: F.contains(t, k))), F.lit(0))


def format_fixed(c, decimals: int) -> Column:
    """Fixed number of decimals, like ``f"{x:.Nf}"`` (ties of the shortest decimal
    form round half up)."""
    return F.format_string(f"%.{decimals}f", as_col(c).cast("double"))


def format_signed(c, decimals: int) -> Column:
    """With a sign, like ``f"{x:+.Nf}"``."""
    return F.format_string(f"%+.{decimals}f", as_col(c).cast("double"))


def format_percent(c, decimals: int = 0) -> Column:
    """Percentage, like ``f"{x:.0%}"``."""
    return F.format_string(f"%.{decimals}f%%", as_col(c).cast("double") * 100)


def session_suffix(message, session_id) -> Column:
    """Old run-log encoding: ``message + ' [session:<id>]'`` when an id is given."""
    s = as_col(session_id)
    return F.concat(as_col(message),
                    F.when(s.isNotNull() & (s != ""), F.concat(F.lit(" [session:"), s, F.lit("]")))
                    .otherwise(F.lit("")))


def parse_session_suffix(c) -> Column:
    """Reads the session id back out of an old-style run input (null when absent)."""
    v = F.regexp_extract(as_col(c), r"\[session:(.*)\]$", 1)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(v)
