"""Quality flags and character fields of source files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_from_int(c: Column) -> Column:
    """0 to 9 as text; anything else, null too, is no flag."""
    return F.when(c.between(0, 9), c.cast("string")).otherwise(F.lit(""))


def flag_from_char(c: Column) -> Column:
    """NUL, space and null are no flag; other characters stay."""
    return F.when(c.isNull() | c.isin(" ", "\0"), F.lit("")).otherwise(c)


def packed_text(c: Column) -> Column:
    """A fixed-width character field without its spaces and NULs."""
    return F.regexp_replace(c, "[ \\x00]", "")


def float_or_nan(c: Column, fill: Column | float | None) -> Column:
    """A float with the fill value, null and absence as NaN."""
    nan = F.lit(float("nan")).cast("float")
    plain = F.coalesce(c.cast("float"), nan)
    if fill is None:
        return plain
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.when(plain == fill.cast("float"), nan).otherwise(plain)
