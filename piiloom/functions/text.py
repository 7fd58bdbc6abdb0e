"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(text: Column) -> Column:
    """Remove all leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def percent_encode(text: Column) -> Column:
    """Percent-encode as in a URI path segment: only ``A-Z a-z 0-9 - . _ ~`` stay."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")),
                               F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot, null without a dot."""
    return F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1)))


def escape_markup(text: Column) -> Column:
    escaped = F.replace(text, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))


def lookup(table: dict, key: Column, default=None) -> Column:
    """Constant-table lookup as one CASE expression."""
    result = None
    for name, value in table.items():
        result = (F.when(key == name, F.lit(value)) if result is None
                  else result.when(key == name, F.lit(value)))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if result is None else result.otherwise(fallback)
