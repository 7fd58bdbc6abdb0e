"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection may be merged into its consumers, or copied into a
    filter pushed below it, and an expensive expression would then run again
    for each use.  A generator over a one-element array is a boundary the
    optimizer keeps, at the price of one row copy.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def utc_now() -> Column:
    """The present time in UTC without a zone, whatever the session's zone is."""
    local = F.current_timestamp().cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
