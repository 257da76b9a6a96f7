"""Text and number parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text forms that count as a number.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(col: Column) -> Column:
    """Text to double, anything else to null."""
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def parse_currency(col: Column) -> Column:
    """``$1,234.56`` to 1234.56; bad text to null."""
    return to_number(F.regexp_replace(col, "[$,]", ""))


def normalize_text(col: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces, stand-alone digit runs to ``NUM``."""
    text = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    text = F.regexp_replace(text, r"\p{Punct}", " ")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_replace(text, r"(?U)\b\d+\b", "NUM")


def amount_text(col: Column, digits: int) -> Column:
    """A rounded amount as a message shows it: no padding zeros, but at least one decimal."""
    fixed = F.round(col, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")
