"""Regular expressions with the semantics of the audited rules: ASCII boundaries, half-up rounding, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A boundary of ASCII words; Java's own is Unicode-aware.
B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: What \\s matches.
SPACE = " \t\n\x0b\f\r"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def occurrences(text: Column, literal: str) -> Column:
    """Places of a literal that don't overlap, without a regular expression."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return (gone / len(literal.encode())).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on the binary double, halves toward +infinity."""
    f = float(10**digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)) / F.lit(f)
