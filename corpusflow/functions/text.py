"""Scalar string helpers that stay JVM-side (codegen'd built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set: Unicode White_Space plus the ASCII separators 0x1C-0x1F.
PY_SPACE = r"[\s\x{1C}-\x{1F}]"
# ASCII whitespace the stdlib wrapper treats as break points (each becomes one space).
WRAP_SPACE = r"[\t\n\x{0B}\f\r ]"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: ``trim`` only strips spaces, so strip both ends by regex."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^" + PY_SPACE + "+", ""), r"(?U)" + PY_SPACE + "+$", "")


def has_text(c: Column) -> Column:
    """True when ``c`` holds a non-whitespace character (Unicode aware; null stays null)."""
    return c.rlike(r"(?U)[^\s\x{1C}-\x{1F}]")


def clamp(c: Column, lo: int = 10, hi: int = 50) -> Column:
    """``max(min(x, hi), lo)`` (C7); null stays null (``least``/``greatest`` skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def default(c: Column, value) -> Column:
    """Missing argument gets its default."""
    return F.coalesce(c, F.lit(value))
