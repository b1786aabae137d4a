"""Row predicates and string helpers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() grammar: optional blanks and sign, digits with single
# underscores between them, optional fraction and exponent, or inf/infinity/nan.
_D = r"[0-9](?:_?[0-9])*"
NUMERIC_PATTERN = (
    r"(?i)^\s*[+-]?(?:(?:" + _D + r"(?:\." + r"(?:" + _D + r")?)?|\." + _D + r")(?:e[+-]?" + _D + r")?"
    r"|inf(?:inity)?|nan)\s*$"
)


def is_num(col: Column | str) -> Column:
    """Would Python's float() accept this string?  Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").rlike(NUMERIC_PATTERN)


def split_part(col: Column | str, i: int, sep: str = ",") -> Column:
    """Part i (0-based) of a delimited string, null when absent (never raises)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.get(F.split(c, sep), i)
