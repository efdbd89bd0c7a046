"""Days since 1950-01-01 as timestamps, in the two ways the commands need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MS = -631_152_000_000
#: Days either way from 1950 beyond which a time is taken for the limit, or for unknown: both stay within four-digit years.
_FAR = 700_000.0


def days_to_timestamp(days: Column) -> Column:
    """Whole days and whole seconds, both truncated toward zero; NaN and null give the epoch."""
    d = F.greatest(F.least(F.nanvl(F.coalesce(days.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(_FAR)), F.lit(-_FAR))
    whole = d.cast("bigint")
    seconds = ((d - whole) * 86400.0).cast("bigint")
    return F.expr("timestamp_ntz '1950-01-01 00:00:00'") + F.make_dt_interval(whole.cast("int"), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def days_to_ms(days: Column) -> Column:
    """Unix milliseconds, rounded; null where the time isn't finite."""
    d = days.cast("double")
    usable = ~F.isnan(d) & (F.abs(d) <= _FAR)
    return F.when(usable, F.round(F.when(usable, d) * 86_400_000.0).cast("bigint") + F.lit(EPOCH_MS))


def timestamp_ms(ts: Column) -> Column:
    """Unix milliseconds of a timestamp without a zone (or of one read as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def ms_to_ntz(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


#: The directives that time formats may use, and their date_format patterns.
DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss",
    "%b": "MMM", "%h": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%I": "hh", "%p": "a", "%D": "MM/dd/yy", "%R": "HH:mm", "%X": "HH:mm:ss", "%x": "MM/dd/yy", "%3f": "SSS",
}
#: Directives that are the same text for all times, which are in UTC.
LITERALS = {"%%": "%", "%Z": "UTC", "%z": "+0000", "%n": "\n", "%t": "\t"}


def date_pattern(fmt: str) -> str:
    """A strftime format as a date_format pattern; ValueError for directives that aren't known."""
    out, literal, k = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while k < len(fmt):
        if fmt[k] == "%":
            own = fmt[k : k + 3] if fmt[k : k + 3] in DIRECTIVES else fmt[k : k + 2]
            if own in LITERALS:
                literal += LITERALS[own]
            elif own in DIRECTIVES:
                flush()
                out.append(DIRECTIVES[own])
            else:
                raise ValueError(f"invalid time format {fmt!r}: {own!r}; known are {' '.join([*DIRECTIVES, *LITERALS])}")
            k += len(own)
        else:
            literal += fmt[k]
            k += 1
    flush()
    return "".join(out)
