"""Keys by which profiles count as the same cast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import date_pattern, ms_to_ntz

ROUND_MODES = ("round", "floor", "ceil", "trunc")


@dataclass(frozen=True)
class KeyOptions:
    time_format: str = "%Y-%m-%d"
    decimals: int = 3
    round_mode: str = "round"

    def __post_init__(self):
        date_pattern(self.time_format)
        if self.round_mode not in ROUND_MODES:
            raise ValueError(f"round mode {self.round_mode!r}; known are {', '.join(ROUND_MODES)}")
        if self.decimals < 0:
            raise ValueError("decimals must not be negative")


def scaled(c: Column, options: KeyOptions) -> Column:
    """A coordinate times 10^decimals as a whole number. The product is rounded half away from zero in
    binary; rounding the decimal text of the value would give other keys."""
    x = c.cast("double") * F.lit(float(10**options.decimals))
    x = F.when(F.abs(x) < 9e18, x)
    if options.round_mode == "floor":
        return F.floor(x)
    if options.round_mode == "ceil":
        return F.ceil(x)
    whole = x.cast("bigint")
    if options.round_mode == "trunc":
        return whole
    rest = x - whole.cast("double")
    return F.when(rest >= 0.5, whole + 1).when(rest <= -0.5, whole - 1).otherwise(whole)


def time_key(ms: Column, options: KeyOptions) -> Column:
    return F.date_format(ms_to_ntz(ms), date_pattern(options.time_format))


def cast_key(ms: Column, longitude: Column, latitude: Column, options: KeyOptions) -> Column:
    """struct(t, x, y), or null without a time or a position."""
    usable = ms.isNotNull() & longitude.isNotNull() & ~F.isnan(longitude) & latitude.isNotNull() & ~F.isnan(latitude)
    return F.when(usable, F.struct(time_key(ms, options).alias("t"), scaled(longitude, options).alias("x"), scaled(latitude, options).alias("y")))
