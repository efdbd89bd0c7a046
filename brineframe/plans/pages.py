"""Summary pages: what the reports of a product's stages say, as a list of blocks, written as Markdown or HTML.

A page is a flat list of blocks, pairs of a kind and its content:

* ``(1, "Cleaning")``: a heading of that level;
* ``("text", "...")`` and ``("name", "...")``: a paragraph, and the name of the table after it;
* ``("sources", ["report/..."])``: the files that what follows comes from;
* ``("grid", [[...], ...])``: a table, its first row the column names.
"""

from __future__ import annotations

import csv
import math
from collections.abc import Iterator, Sequence
from itertools import groupby
from pathlib import Path

#: Groups of more profiles than this share the last line of the size table.
CAP = 10
#: Places of the reports of a product, below the report folder.
STAGES = {"convert": "convert", "dropqc": "clean/dropqc", "dropna": "clean/dropna", "filter": "clean/filter", "markdup": "dedup/markdup", "dedup": "dedup/dedup"}
#: Our own explanations. Headings and column names in this module are fixed values: the output format.
TEXT = {
    "files": "How many of the source files have each core variable and each of the two profile flags; a variable counts when it is present, whatever its values. Other variables are listed below.",
    "convert": "Counts right after conversion, before anything is dropped. Later stages are measured against them.",
    "cleaning": "Stages that drop unusable or distant profiles, each on the result of the one before.",
    "dropqc": "Profiles whose time or position flag is bad are dropped; good (1) and absent flags stay.",
    "dropna": "Profiles without a single valid value of temperature, salinity or pressure are dropped.",
    "filter": "Profiles inside the region's box stay; those without a position are dropped.",
    "bbox": "Extremes of the positions that are left, in degrees, beside those of the converted data where known.",
    "dedup": "Profiles that share a date and a rounded position, on whatever platform, are found and thinned out.",
    "markdup": "Profiles that share their key with others are marked. Nothing is removed yet.",
    "remove": "Of each key the profile with most observations stays, of equal ones the first. Profiles without a key always stay.",
    "within": "Groups of duplicates on a single platform; shares are of all duplicate profiles.",
    "across": "Groups of duplicates on two or more platforms; shares are of all duplicate profiles.",
    "sizes": "Profiles in a group of duplicates; the last line holds all larger groups.",
    "compare": "What other products of the region hold of this one, by date and rounded position, one way only.",
    "totals": "This product's own totals, of which the shares below are taken. Profiles without a key match nothing.",
    "coverage": "Each other product's share of this one's platforms and profiles, and how many of the profiles in both have equally many observations.",
}
NOTHING = "No section source files were found."
Block = tuple[int | str, str | list]


def rows_of(path: Path) -> list[dict[str, str | None]]:
    with open(path, newline="") as f:
        return list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))


def number(cell: str | None) -> float:
    try:
        return float(cell or "nan")
    except ValueError:
        return math.nan


def whole(cell: str | None) -> int:
    """A count, however it is written; what isn't one is 0."""
    v = number(cell)
    return max(0, math.floor(v + 0.5)) if math.isfinite(v) else 0


def added(rows: list[dict], column: str) -> int:
    return sum(whole(r.get(column)) for r in rows)


def of(n: float, base: float) -> str:
    """A share in percent; nothing of nothing."""
    return f"{100.0 * n / base:.1f}%" if base else ""


def size(rows: list[dict]) -> dict[str, int]:
    """What a stage left, from its report by platform."""
    return {"Platforms": len(rows), "Profiles": added(rows, "n_profiles"), "Observations": added(rows, "n_obs")}


def extremes(rows: list[dict]) -> dict[str, str]:
    """The box of all platforms, in degrees; empty where nothing is known."""
    out = {}
    for c in ("longitude", "latitude"):
        for name, pick in (("min", min), ("max", max)):
            known = [v for r in rows if not math.isnan(v := number(r.get(f"{c}_{name}")))]
            out[f"{c.capitalize()} {name}"] = f"{pick(known):.3f}" if known else ""
    return out


def left_over(now: dict[str, int], first: dict[str, int], cleaned: dict[str, int] | None = None, more: Sequence[list[str]] = ()) -> Block:
    """What is left of the first stage, and of the cleaned product where there is one."""
    grid = [["Metric", "Count", "% of original", "Deleted"]]
    grid += [[k, f"{n:,}", of(n, first[k]), of(first[k] - n, first[k])] for k, n in now.items()]
    if cleaned:
        grid[0] += ["Cleaned", "% of cleaned", "Deleted (cleaned)"]
        for row, k in zip(grid[1:], now):
            row += [f"{cleaned[k]:,}", of(now[k], cleaned[k]), of(cleaned[k] - now[k], cleaned[k])]
    return "grid", [*grid, *more]


def source_files(path: Path) -> Iterator[Block]:
    rows = rows_of(path)
    yield 1, "File summary"
    yield "text", TEXT["files"]
    yield "sources", [path.as_posix()]
    grid = [["Metric", "Count", "% of files"], ["Files", f"{len(rows):,}", ""]]
    for name in ("TEMP", "PSAL", "PRES", "DEPH", "TIME_QC", "POSITION_QC"):
        n = sum(r.get(f"has_{name.lower()}") == "true" for r in rows)
        grid.append([f"with {name}", f"{n:,}", of(n, len(rows))])
    others = {x.strip() for r in rows for x in (r.get("extra_params") or "").split(";")} - {""}
    yield "grid", [*grid, ["Extra parameters", ", ".join(sorted(others)) or "none", ""]]


def cleaning(reports: dict[str, list[dict]], places: dict[str, Path], first: dict[str, int]) -> Iterator[Block]:
    titles = {"dropqc": "Drop bad QC", "dropna": "Drop all-NA profiles", "filter": "Filter by region"}
    steps = [k for k in titles if k in reports]
    if steps:
        yield 1, "Cleaning"
        yield "text", TEXT["cleaning"]
    for k in steps:
        yield 2, titles[k]
        yield "text", TEXT[k]
        yield "sources", [places[k].as_posix()]
        yield left_over(size(reports[k]), first)
    if "filter" in steps and any((now := extremes(reports["filter"])).values()):
        before = extremes(reports.get("convert", []))
        known = any(before.values())
        yield "name", "Bounding box"
        yield "text", TEXT["bbox"]
        yield "grid", [["Metric", "Filtered", *["Original"] * known], *([k, v, *[before[k]] * known] for k, v in now.items())]


def groups_of_duplicates(rows: list[dict]) -> Iterator[Block]:
    """Tables on the groups of the duplicates report: on one platform, on several, and by size."""
    key = lambda r: r.get("dup_group") or ""
    each = [(len(g), added(g, "n_obs"), {r.get("platform_code") or "" for r in g}) for _, own in groupby(sorted(rows, key=key), key) for g in [list(own)]]
    profiles, obs = (sum(g[i] for g in each) for i in (0, 1))
    for title, text, one in (("Duplicates within a platform", "within", True), ("Duplicates across platforms", "across", False)):
        some = [g for g in each if (len(g[2]) < 2) == one]
        n, o = (sum(g[i] for g in some) for i in (0, 1))
        yield "name", title
        yield "text", TEXT[text]
        grid = [["Metric", "Count", "% of duplicates"], ["Duplicate groups", f"{len(some):,}", ""], ["Duplicate profiles", f"{n:,}", of(n, profiles)]]
        yield "grid", [*grid, ["Platforms", f"{len(set().union(*(g[2] for g in some))):,}", ""], ["Observations", f"{o:,}", of(o, obs)]]
    sizes = sorted(g[0] for g in each)
    grid = [["Profiles per group", "Groups", "Profiles", "% of duplicates"]]
    for k, own in groupby(sizes, lambda n: min(n, CAP + 1)):
        own = list(own)
        grid.append([str(k) if k <= CAP else f"{k}+", f"{len(own):,}", f"{sum(own):,}", of(sum(own), profiles)])
    yield "name", "Duplicate group sizes"
    yield "text", TEXT["sizes"]
    yield "grid", grid


def deduplication(reports: dict[str, list[dict]], places: dict[str, Path], first: dict[str, int], cleaned: dict[str, int] | None, groups: Path) -> Iterator[Block]:
    if not {"markdup", "dedup"} & reports.keys():
        return
    yield 1, "Deduplication"
    yield "text", TEXT["dedup"]
    if "markdup" in reports:
        n = added(reports["markdup"], "dup_profiles")
        more = ["Duplicate profiles", f"{n:,}", of(n, first["Profiles"]), ""] + ([f"{cleaned['Profiles']:,}", of(n, cleaned["Profiles"]), ""] if cleaned else [])
        yield 2, "Mark duplicates"
        yield "text", TEXT["markdup"]
        yield "sources", [p.as_posix() for p in (places["markdup"], groups) if p.exists()]
        yield left_over(size(reports["markdup"]), first, cleaned, [more])
        if groups.exists():
            yield from groups_of_duplicates(rows_of(groups))
    if "dedup" in reports:
        yield 2, "Remove duplicates"
        yield "text", TEXT["remove"]
        yield "sources", [places["dedup"].as_posix()]
        yield left_over(size(reports["dedup"]), first, cleaned)


def comparison(folder: Path, stem: str) -> Iterator[Block]:
    """From the rows that have this product as their reference. Shares are computed from the counts."""
    found = {p: [r for r in rows_of(p) if r.get("reference") == stem] for p in sorted(folder.glob("*.tsv"))}
    rows = sorted((r for own in found.values() for r in own), key=lambda r: r.get("compared") or "")
    if not rows:
        return
    yield 1, "Comparison"
    yield "text", TEXT["compare"]
    yield "sources", [p.as_posix() for p, own in found.items() if own]
    yield "name", "This product"
    yield "text", TEXT["totals"]
    totals = {"Platforms": "ref_platforms", "Profiles": "ref_profiles", "Profiles without a key": "ref_unkeyed_profiles", "Observations": "ref_observations"}
    yield "grid", [["Metric", "Count"], *([k, f"{whole(rows[0].get(c)):,}"] for k, c in totals.items())]
    yield "name", "Coverage of other products"
    yield "text", TEXT["coverage"]
    grid = [["Compared with", "Common platforms", "Platform coverage", "Matched profiles", "Profile coverage", "Same obs", "Diff obs", "Obs agreement"]]
    for r in rows:
        n = {c: whole(v) for c, v in r.items() if c not in ("reference", "compared")}
        shares = [of(n.get(a, 0), n.get(b, 0)) for a, b in (("common_platforms", "ref_platforms"), ("matched_profiles", "ref_profiles"), ("same_nobs", "matched_profiles"))]
        counts = [f"{n.get(c, 0):,}" for c in ("common_platforms", "matched_profiles", "same_nobs", "diff_nobs")]
        grid.append([r.get("compared") or "", counts[0], shares[0], counts[1], shares[1], counts[2], counts[3], shares[2]])
    yield "grid", grid


def blocks(stem: str, report_dir: str | Path = "report", out_dir: str | Path = "output") -> list[Block]:
    """All that the reports of a product say, in page order; parts without a report are left out."""
    top = Path(report_dir)
    places = {k: top / sub / f"{stem}.parquet.tsv" for k, sub in STAGES.items()}
    reports = {k: rows_of(p) for k, p in places.items() if p.exists()}
    last_clean = next((k for k in ("filter", "dropna", "dropqc") if k in reports), None)
    out: list[Block] = []
    if (header := top / "header" / f"{stem}.yaml.tsv").exists():
        out += source_files(header)
    if reports:
        first = size(next(iter(reports.values())))  # stages are in order
        if "convert" in reports:
            out += [(1, "Conversion"), ("text", TEXT["convert"]), ("sources", [places["convert"].as_posix()]), ("grid", [["Metric", "Count"], *([k, f"{n:,}"] for k, n in first.items())])]
        out += cleaning(reports, places, first)
        out += deduplication(reports, places, first, size(reports[last_clean]) if last_clean else None, Path(out_dir) / "dedup" / "markdup" / f"{stem}.dups.tsv")
    return [*out, *comparison(top / "compare", stem)]


def markdown(title: str, notes: Sequence[str], parts: Sequence[Block]) -> str:
    def lines(kind: int | str, what: str | list) -> str:
        if isinstance(kind, int):
            return f"{'#' * (kind + 1)} {what}"
        if kind == "grid":
            head, *rows = ("| " + " | ".join(r) + " |" for r in what)
            return "\n".join([head, "| " + " | ".join(["---"] * len(what[0])) + " |", *rows])
        return {"name": f"**{what}**", "sources": "\n".join(f"- File: `{f}`" for f in what)}.get(kind, what)

    body = [lines(*b) for b in parts] or [f"_{NOTHING}_"]
    return "\n\n".join([f"# {title}", *(f"> {n}" for n in notes), *body]) + "\n"


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


STYLE = """
:root { color-scheme: light dark; font: 1rem/1.6 Georgia, serif }
main { width: min(46em, 92vw); margin-inline: auto }
table { width: 100%; border-spacing: 0 }
thead { text-align: start; font-variant: small-caps }
tbody tr:nth-child(odd) { background: #80808018 }
td + td { text-align: end }
"""


def html(title: str, notes: Sequence[str], parts: Sequence[Block]) -> str:
    e = escaped

    def element(kind: int | str, what: str | list) -> str:
        if isinstance(kind, int):
            return f"<h{kind + 1}>{e(what)}</h{kind + 1}>"
        if kind == "grid":
            line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{e(c)}</{tag}>" for c in cells) + "</tr>"
            return f"<table><thead>{line(what[0], 'th')}</thead><tbody>{''.join(line(r, 'td') for r in what[1:])}</tbody></table>"
        if kind == "sources":
            return "<p>" + "<br>".join(f"File: <code>{e(f)}</code>" for f in what) + "</p>"
        return f"<h4>{e(what)}</h4>" if kind == "name" else f"<p>{e(what)}</p>"

    body = [element(*b) for b in parts] or [f"<p><em>{NOTHING}</em></p>"]
    head = [f"<h1>{e(title)}</h1>", *(f"<aside>{e(n)}</aside>" for n in notes)]
    return f'<!DOCTYPE html>\n<html lang="en">\n<meta charset="utf-8">\n<title>{e(title)}</title>\n<style>{STYLE}</style>\n<main>\n' + "\n".join([*head, *body]) + "\n</main>\n</html>\n"


def page(stem: str, report_dir: str | Path = "report", out_dir: str | Path = "output", fmt: str = "md", title: str | None = None, notes: Sequence[str] = ()) -> str:
    write = {"md": markdown, "html": html}.get(fmt)
    if write is None:
        raise ValueError(f"format {fmt!r}; known are md and html")
    return write(f"Summary: {stem}" if title is None else title, notes, blocks(stem, report_dir, out_dir))
