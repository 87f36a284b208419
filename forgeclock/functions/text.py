"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"\p{IsWhite_Space}"


def strip(value: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(value, rf"^{BLANKS}+|{BLANKS}+$", "")
