"""Text helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: every kind of space, and invisible characters that stand like one.
SPACES = "\\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def single_spaced(text: Column) -> Column:
    """Runs of any kind of space as one plain space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def is_blank(text: Column) -> Column:
    """Whether a text is null or nothing but spaces."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", "") == ""
