"""Scalar functions and orderings whose results differ from Spark's own of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming.
SPACE = r"[\s \u0085  -     　]+"
#: A character that patterns don't use, as LIKE has no default escape here.
NO_ESCAPE = "\x00"


def asc(c: Column | str) -> Column:
    """Ascending with nulls last."""
    return F.asc_nulls_last(c)


def desc(c: Column | str) -> Column:
    """Descending with nulls first."""
    return F.desc_nulls_first(c)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Always a double, half away from zero."""
    return F.round(x.cast("double"), digits)


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start of zero or less is the beginning and does not shorten the length."""
    at = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    if length is None:
        return F.substr(s, at)
    return F.substr(s, at, F.lit(length) if isinstance(length, int) else length)


def concat(*cs: Column) -> Column:
    """The function: skips nulls, turns other types to text."""
    return F.concat_ws("", *[c.cast("string") for c in cs])


def strict_concat(*cs: Column) -> Column:
    """The operator ||: null if any side is."""
    return F.concat(*[c.cast("string") for c in cs])


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}|{SPACE}$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}$", "")


def mod(x: Column, y: Column) -> Column:
    """Euclidean remainder by |y| with the sign of y; an error for y = 0."""
    y = y.cast("bigint")
    return F.pmod(x.cast("bigint"), F.abs(y)) * F.when(y < 0, F.lit(-1).cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def int_div(x: Column, y: Column) -> Column:
    """Integer division, truncated; an error for y = 0."""
    x, y = x.cast("bigint"), y.cast("bigint")
    # x - x % y is a multiple of y; decimals keep all digits
    return ((x - x % y).cast("decimal(38,0)") / y.cast("decimal(38,0)")).cast("bigint")


def like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without a default escape character."""
    esc = F.lit(escape or NO_ESCAPE)
    return F.like(s, F.lit(pattern), esc)


def widened(x: Column) -> Column:
    """Integers widen to bigint before arithmetic, which then fails beyond 64 bits."""
    return x.cast("bigint")
