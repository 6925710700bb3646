"""Wiki-markup section extraction as a Java regex (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, py_strip


def _quoted(name: str) -> str:
    return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def section_pattern(name: str) -> str:
    """Heading ``==+ name ==+`` (any level, case-insensitive, not anchored to a
    line start); the body runs to the next heading of any level, sub-headings
    included, or to the end of the text."""
    return r"(?isuU)==+\s*" + _quoted(name) + r"\s*==+(.*?)(?===+[^=]|\z)"


def level_pattern(name: str, level: int) -> str:
    """Heading of exactly ``level`` '=' signs; the body runs to the next heading
    of the same or a higher level (fewer or equal '='), sub-headings kept."""
    run = r"(?<!=)={%d}(?!=)" % level
    stop = r"(?<!=)={2,%d}(?!=)" % level
    return r"(?isuU)" + run + r"\s*" + _quoted(name) + r"\s*" + run + r"(.*?)(?=" + stop + r"|\z)"


def extract_section(wikitext, name: str, include_subsections: bool = False, max_level: int = 6) -> Column:
    """First matching section's stripped body, or '' when there is none.

    Default: the body ends at the next heading of any level (the original
    behaviour, which drops everything after a section's first sub-heading).
    ``include_subsections=True``: the body ends at the next heading of the same
    or a higher level; the first heading in the text that names the section
    decides the level."""
    t = F.coalesce(as_col(wikitext), F.lit(""))
    if not include_subsections:
        return py_strip(F.regexp_extract(t, section_pattern(name), 1))
    levels = list(range(2, max_level + 1))
    pos = {lv: F.regexp_instr(t, F.lit(level_pattern(name, lv))) for lv in levels}
    big = F.lit(2 ** 31 - 1)
    first = F.least(*[F.when(pos[lv] > 0, pos[lv]).otherwise(big) for lv in levels])
    body = F.lit("")
    for lv in reversed(levels):
        body = F.when((pos[lv] > 0) & (pos[lv] == first), F.regexp_extract(t, level_pattern(name, lv), 1)).otherwise(body)
    return py_strip(body)
