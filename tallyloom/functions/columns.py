"""Small column helpers shared by the other function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Drop leading and trailing white space of any kind, not only blanks."""
    return F.trim(as_column(text), F.lit(WHITESPACE))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other in the given order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
