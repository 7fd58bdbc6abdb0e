"""Cheap access to the middle of long texts.

``substring`` walks a UTF-8 string from its beginning, so taking many pieces of
one long text costs its length each time.  A text cut once into chunks of equal
length gives any piece at the price of a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from piiloom.functions.sqltext import name

CHUNK = 1024


def chunks_sql(text: str) -> str:
    """``text`` as an array of strings of ``CHUNK`` characters, the last one shorter."""
    return (f"if(octet_length({text}) <= {CHUNK}, array({text}),"
            f" regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0))")


def cut_sql(chunks: str, start: str, length: str) -> str:
    """``length`` characters from the 0-based ``start`` of a chunked text."""
    first, offset = f"(({start}) div {CHUNK})", f"(({start}) % {CHUNK})"
    end = f"(({start}) + ({length}))"
    last = f"({end} div {CHUNK})"
    within = f"coalesce(substring(get({chunks}, {first}), {offset} + 1, {length}), '')"
    across = (f"concat(substring(get({chunks}, {first}), {offset} + 1, {CHUNK}),"
              f" array_join(slice({chunks}, {first} + 2, {last} - {first} - 1), ''),"
              f" coalesce(substring(get({chunks}, {last}), 1, {end} % {CHUNK}), ''))")
    return f"if({offset} + ({length}) <= {CHUNK}, {within}, {across})"


def chunks_where(needed: str, text: str = "text") -> Column:
    """Chunks of ``text`` on rows where the SQL condition ``needed`` holds, else none."""
    return F.expr(f"if({needed}, {chunks_sql(name(text))}, cast(array() as array<string>))")
