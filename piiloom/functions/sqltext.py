"""Literals for Spark SQL text."""

from __future__ import annotations


def string(value: str | None) -> str:
    """A string literal; raw, so that backslashes in patterns stay as they are."""
    if value is None:
        return "cast(null as string)"
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in value.split("'")) + ")"


def number(value: float) -> str:
    return f"{float(value)!r}D"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
