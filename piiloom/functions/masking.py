"""Replacement values for one matched value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from piiloom import rules as R

REDACTED = "[REDACTED]"
DEFAULT_SALT = "piiloom"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def light(value: Column) -> Column:
    """Keep two characters at each end; short values go entirely."""
    size = F.char_length(value)
    masked = F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), size - 4),
                      F.right(value, F.lit(2)))
    return F.when(size < 5, F.lit(REDACTED)).otherwise(masked)


def full(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(REDACTED))


def _digest(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), value), 256)


def _number(digest: Column, at: int, width: int = 6) -> Column:
    """The hexadecimal digits ``at .. at+width`` of a digest as an integer."""
    return F.conv(F.substring(digest, at, width), 16, 10).cast("long")


def _digits(digest: Column, at: int, count: int) -> Column:
    """``count`` (up to 11) decimal digits from 12 hexadecimal ones."""
    return F.lpad((_number(digest, at, 12) % 10 ** count).cast("string"), count, "0")


def _letter(digest: Column, at: int) -> Column:
    return F.substring(F.lit(_LETTERS), (_number(digest, at, 4) % 26 + 1).cast("int"), F.lit(1))


def _pick(options, digest: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (_number(digest, at) % len(options) + 1).cast("int"))


def synthetic_aadhaar(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """Twelve digits, the first 2-9, in the separator style of ``value``."""
    d = _digest(value, salt)
    number = F.concat((_number(d, 1) % 8 + 2).cast("string"), _digits(d, 7, 11))
    blocks = [F.substring(number, i, 4) for i in (1, 5, 9)]
    return (F.when(value.contains("-"), F.concat_ws("-", *blocks))
            .when(value.contains(" "), F.concat_ws(" ", *blocks)).otherwise(number))


def synthetic_pan(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """Five letters, four digits, one letter."""
    d = _digest(value, salt)
    return F.concat(*[_letter(d, 1 + 4 * i) for i in range(5)],
                    _digits(d, 21, 4), _letter(d, 33))


def synthetic_license(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """State code, office 01-99, year 2000-2026 and seven digits, spaced or not."""
    d = _digest(value, salt)
    gap = F.when(_number(d, 37, 1) % 2 == 0, F.lit(" ")).otherwise(F.lit(""))
    office = F.lpad((_number(d, 7) % 99 + 1).cast("string"), 2, "0")
    year = (_number(d, 13) % 27 + 2000).cast("string")
    return F.concat(_pick(R.STATE_CODES, d, 1), office, gap, year, gap, _digits(d, 19, 7))


def synthetic_email(value: Column, salt: str = DEFAULT_SALT) -> Column:
    d = _digest(value, salt)
    return F.concat(F.lower(_pick(R.FIRST_NAMES, d, 1)), F.lit("."),
                    F.lower(_pick(R.LAST_NAMES, d, 7)), _digits(d, 13, 4),
                    F.lit("@example.com"))


def synthetic_phone(value: Column, salt: str = DEFAULT_SALT) -> Column:
    d = _digest(value, salt)
    return F.concat(F.lit("+91 "), (_number(d, 1) % 4 + 6).cast("string"),
                    _digits(d, 7, 4), F.lit(" "), _digits(d, 19, 5))


def synthetic_name(value: Column, salt: str = DEFAULT_SALT) -> Column:
    d = _digest(value, salt)
    return F.concat(_pick(R.FIRST_NAMES, d, 1), F.lit(" "), _pick(R.LAST_NAMES, d, 7))


def synthetic(value: Column, entity_type: Column, salt: str = DEFAULT_SALT) -> Column:
    """A format-matching stand-in; equal inputs get equal stand-ins."""
    return (F.when(entity_type == "AADHAAR", synthetic_aadhaar(value, salt))
            .when(entity_type == "PAN", synthetic_pan(value, salt))
            .when(entity_type == "DRIVING_LICENSE", synthetic_license(value, salt))
            .when(entity_type.isin("EMAIL", "EMAIL_ADDRESS"), synthetic_email(value, salt))
            .when(entity_type.isin("PHONE", "PHONE_NUMBER"), synthetic_phone(value, salt))
            .when(entity_type == "PERSON", synthetic_name(value, salt))
            .otherwise(full(value)))


def replacement(value: Column, entity_type: Column, level: str,
                salt: str = DEFAULT_SALT) -> Column:
    """The replacement at a redaction level; an unknown level is an error."""
    if level == "LIGHT":
        return light(value)
    if level == "FULL":
        return full(value)
    if level == "SYNTHETIC":
        return synthetic(value, entity_type, salt)
    raise ValueError(f"unknown redaction level {level!r}; use one of {R.REDACTION_LEVELS}")
