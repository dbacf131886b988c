"""String helpers with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: A word in the sense of ``str.split()``, as a regular expression.
WORD = f"[^{WHITESPACE}]+"


def strip(col: Column) -> Column:
    """``str.strip()``: white space off both ends, including the non-ASCII kinds."""
    return F.btrim(col, F.lit(WHITESPACE))


def word_count(col: Column) -> Column:
    """``len(text.split())``."""
    return F.regexp_count(col, F.lit(WORD))


def quote(literal: str) -> str:
    """``literal`` as a regular expression that matches exactly itself."""
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|&" else c for c in literal)


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern``, in order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def last_match(col: Column, pattern: str, group: int = 0) -> Column:
    """The last match, or null."""
    return F.try_element_at(find_all(col, pattern, group), F.lit(-1))


def digest(array: Column) -> Column:
    """MD5 over the comma-joined elements, to compare long arrays cheaply."""
    return F.md5(F.array_join(array.cast("array<string>"), ",", "null"))
