"""Regular-expression and number helpers whose results must not depend on Unicode word rules or decimal rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary over ASCII letters, digits and underscore (the engine's own \b also sees accented letters as word characters).
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Spaces other than the plain one that count as white space in texts from the web.
ODD_SPACES = "\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def edged(pattern: str) -> str:
    """The pattern with each \\b replaced by an ASCII word boundary."""
    return pattern.replace(r"\b", EDGE)


def plain_spaces(text: Column) -> Column:
    """Odd spaces as plain ones, so that \\s and trim see them; applied once at entry."""
    return F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))


def filled(text: Column) -> Column:
    """Null for an empty text: absent, null and empty mean the same."""
    return F.nullif(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none or it is empty."""
    return filled(F.regexp_extract(text, edged(pattern), group))


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(edged(pattern)))


def round2(x: Column) -> Column:
    """Two decimals, halves up, in binary floating point throughout."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` evaluated once, however often `use` refers to it, and copied once where a filter is pushed down."""
    return F.transform(F.array(value), use)[0]
