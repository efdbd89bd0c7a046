"""Missing values: NaN or null for numbers. No aggregate touches a measurement without these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Measurements that a profile is judged by.
MEASURES = ("temp", "psal", "pres")


def is_missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c)


def valid(c: Column | str) -> Column:
    """The value, or null if it is missing, so that aggregates pass over it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def require(columns: list[str], *needed: str) -> None:
    lacking = [c for c in needed if c not in columns]
    if lacking:
        raise ValueError(f"missing columns {', '.join(lacking)}; there are {', '.join(columns)}")
