"""Cells of reports as column expressions, with exact rules, so that executors write what they hold.

Fixed values, the output format: numbers have up to four decimals, rounded from their exact binary value with ties to even, without
trailing zeros; NaN and null are empty; times are ``2020-01-31T06:00:00Z``; booleans are true and false. Numbers of
the duplicates table are not rounded: they have the shortest text that reads back the same, without an exponent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below, a number of four decimals is told apart by its shortest text.
_DENSE = float(1 << 37)
#: From here on a fraction is a multiple of 2^-43, and ten thousand times one is exact.
_EXACT = 512.0
#: Up to here whole parts are longs.
_LONG = 9.2e18
#: What JSON escapes; the common ones are replaced one by one, the others by a fold, only in texts that hold one.
_COMMON = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_RARE = {"\b": "\\b", "\f": "\\f"} | {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in "\n\r\t\b\f"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used: an expression that repeats its parts doubles with
    each step until Spark can't compile it."""
    return F.transform(F.array(value), then)[0]


def four_decimals(value: Column) -> Column:
    """A number with up to four decimals; empty if there is none. Beyond 2^63, digits after the seventeenth are zeros."""
    v = value.cast("double")
    return F.coalesce(_finite(v), F.when(v == F.lit(float("inf")), "inf").when(v == F.lit(float("-inf")), "-inf"), F.lit(""))


def _finite(v: Column) -> Column:
    """The text of a double; null for what is no finite number.

    The number is rounded first, so that its text has no more decimals to drop. A product that isn't halfway between whole numbers lies on the
    same side of that as the exact one. Only the others, and large numbers, take a lambda, which is run step by step; what holds one is
    compiled in small methods, while all cells of a line in one method would be more than Java compiles."""
    size = F.abs(v)
    units = (size - F.floor(size)) * 10000.0
    rare = (size >= _DENSE) | ((size < _EXACT) & (units - F.floor(units) == 0.5))
    rounded = F.signum(v) * (F.floor(size) + F.rint(units) / 10000.0)
    return F.when(size < F.lit(float("inf")), F.when(rare, _let(v, _exactly)).otherwise(_formatted(rounded)))


def _exactly(v: Column) -> Column:
    size = F.abs(v)
    rest = size - F.floor(size)
    units = rest * 10000.0
    upper = F.floor(rest * float(1 << 26)) / float(1 << 26)
    error = (upper * 10000.0 - units) + (rest - upper) * 10000.0  # by which the exact product is more; its parts are exact where units are halfway
    halfway = (units - F.floor(units) == 0.5) & (error != 0.0)
    decimals = F.when(halfway, F.floor(units) + (error > 0.0).cast("long")).otherwise(F.rint(units)) / 10000.0
    text = F.concat(F.when(v < 0, "-").otherwise(""), (F.floor(size) + F.floor(decimals)).cast("string"), F.substring(_formatted(decimals), 2, 5))
    return F.when(size < _LONG, text).otherwise(_formatted(v))


def _formatted(v: Column) -> Column:
    return F.call_function("format_number", v, F.lit("0.####"))


def shortest(value: Column) -> Column:
    """A number at its shortest exact length, without an exponent; whole numbers without a point. NaN and null are NaN.
    Below 2.3e-308 it may have a digit more than needed."""
    return _let(value.cast("double"), _shortest)


def _shortest(v: Column) -> Column:
    size = F.abs(v)
    usable = v.isNotNull() & ~F.isnan(v) & (size < F.lit(float("inf"))) & (size > 0)

    def scientific(a: Column) -> Column:
        tries = [F.format_string(f"%.{n}e", a) for n in range(13, 17)]
        return F.coalesce(*(_let(t, lambda t: F.when(t.cast("double") == a, t)) for t in tries), tries[-1])

    def plain(digits: Column, power: Column) -> Column:
        n = F.length(digits)
        far = F.concat(digits, F.expr("repeat('0', 400)").substr(F.lit(1), F.greatest(power + 1 - n, F.lit(0))))
        mixed = F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, n))
        near = F.concat(F.lit("0."), F.expr("repeat('0', 400)").substr(F.lit(1), F.greatest(-power - 1, F.lit(0))), digits)
        return F.when(power < 0, near).when(n <= power + 1, far).otherwise(mixed)

    def parts(text: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        return _let(digits, lambda d: _let(F.substring_index(text, "e", -1).cast("int"), lambda power: plain(d, power)))

    text = _let(F.when(usable, size).otherwise(1.0), lambda a: _let(scientific(a), parts))
    sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    out = F.when(usable, text).when(size == 0, "0").when(size == F.lit(float("inf")), "inf")
    return F.when(v.isNull() | F.isnan(v), "NaN").otherwise(F.concat(sign, out))


def cell(value: Column, kind: T.DataType) -> Column:
    """The text of a cell."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return four_decimals(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    out = text
    for raw, escaped in _COMMON.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = F.array(*(F.struct(F.lit(raw).alias("raw"), F.lit(escaped).alias("escaped")) for raw, escaped in _RARE.items()))
    every = F.reduce(rare, out, lambda own, c: F.replace(own, c["raw"], c["escaped"]))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), every).otherwise(out), F.lit('"'))


def json_cell(value: Column, kind: T.DataType) -> Column:
    """The value of a cell in JSON; null for null and for what is no finite number."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(_finite(value.cast("double")), F.lit("null"))
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(value.isNull(), "null").otherwise(quoted(cell(value, kind)))
