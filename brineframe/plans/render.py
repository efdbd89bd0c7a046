"""Small result tables as TSV, text or JSON, with exact cell rules."""

from __future__ import annotations

import datetime as dt
import json
import math
import sys
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

FORMATS = ("tsv", "text", "json")


def number(v: float) -> str:
    """Four decimals without trailing zeros; NaN is empty."""
    if math.isnan(v):
        return ""
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    text = f"{v:.4f}".rstrip("0").rstrip(".")
    return text


def cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number(v)
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%SZ")
    return str(v)


def json_cell(v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "null"
    if isinstance(v, (bool, int, float)):
        return cell(v)
    return json.dumps(cell(v), ensure_ascii=False)


def tsv(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    return "".join("\t".join(map(cell, r)) + "\n" for r in [list(names), *rows])


def text(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    """One row as a block of labels and values, several as an aligned table."""
    if len(rows) == 1:
        width = max(map(len, names), default=0)
        return "".join(f"{n:<{width}}  {cell(v)}\n" for n, v in zip(names, rows[0]))
    cells = [[cell(v) for v in r] for r in rows]
    widths = [max([len(n.encode()), *(len(r[k].encode()) for r in cells)]) for k, n in enumerate(names)]
    lines = [list(names), ["-" * w for w in widths], *cells]
    return "".join("  ".join(f"{c:<{w}}" for c, w in zip(r, widths)) + "\n" for r in lines)


def as_json(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    records = ("{" + ",".join(f"{json.dumps(n)}:{json_cell(v)}" for n, v in zip(names, r)) + "}" for r in rows)
    return "[" + ",".join(records) + "]\n"


def rendered(names: Sequence[str], rows: Sequence[Sequence], fmt: str = "tsv") -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}; known are {', '.join(FORMATS)}")
    return {"tsv": tsv, "text": text, "json": as_json}[fmt](names, rows)


def emit(content: str, dest: str | Path | None) -> None:
    """To a file, or to standard output."""
    if dest is None:
        sys.stdout.write(content)
        return
    try:
        Path(dest).write_text(content)
    except OSError as e:
        raise OSError(f"cannot create {dest}: {e}") from e


def lines(names: Sequence[str], rows: Iterable[Sequence], fmt: str = "tsv") -> Iterator[str]:
    """A rendered report in parts; only ``text``, which aligns columns, has all rows at once."""
    if fmt == "tsv":
        yield tsv(names, [])
        for r in rows:
            yield tsv(r, [])
    elif fmt == "json":
        before = "["
        for r in rows:
            yield before + as_json(names, [r])[1:-2]
            before = ","
        yield "[]\n" if before == "[" else "]\n"
    else:
        yield rendered(names, list(rows), fmt)


def write_lines(parts: Iterable[str], dest: str | Path | None) -> None:
    """Parts of a text to a file, or to standard output, one after the other."""
    if dest is None:
        sys.stdout.writelines(parts)
        return
    try:
        out = open(dest, "w")
    except OSError as e:
        raise OSError(f"cannot create {dest}: {e}") from e
    with out:
        out.writelines(parts)


def write_report(df: DataFrame, fmt: str = "tsv", dest: str | Path | None = None) -> None:
    """Renders a report; its rows (at most one per profile) come to the driver a partition at a time."""
    write_lines(lines(df.columns, (tuple(r) for r in df.toLocalIterator()), fmt), dest)


def plain(v: float | None) -> str:
    """A float at its shortest exact length, without an exponent; whole numbers without a point."""
    if v is None or math.isnan(v):
        return "NaN"
    out = repr(v)
    if "e" in out or "E" in out:
        from decimal import Decimal

        out = format(Decimal(out), "f")
    return out.removesuffix(".0")


def duplicates_lines(report: DataFrame) -> Iterator[str]:
    """The duplicates table line by line; its numbers are not rounded."""
    names = ["dup_group", "platform_code", "profile_no", "profile_time", "profile_timestamp", "longitude", "latitude", "n_obs"]
    yield "\t".join(names) + "\n"
    for r in report.select(*names).toLocalIterator():
        ts = r["profile_timestamp"]
        stamp = "" if ts is None else ts.strftime("%Y-%m-%d %H:%M:%S") + (f".{ts.microsecond // 1000:03d}" if ts.microsecond else "")
        yield "\t".join([str(r["dup_group"]), r["platform_code"], str(r["profile_no"]), plain(r["profile_time"]), stamp, plain(r["longitude"]), plain(r["latitude"]), str(r["n_obs"])]) + "\n"


def duplicates_tsv(report: DataFrame) -> str:
    """The duplicates table as one text."""
    return "".join(duplicates_lines(report))
