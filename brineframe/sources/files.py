"""Files of a batch: which, in what order, and where their results go."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from fnmatch import fnmatchcase
from pathlib import Path


def listed(folder: str | Path, pattern: str) -> list[Path]:
    """Files below a folder whose name (not path) matches, sorted by path. No match is no error."""
    folder = Path(folder)
    if not folder.is_dir():
        raise NotADirectoryError(f"{folder} is not a folder")
    return sorted(p for p in folder.rglob("*") if p.is_file() and fnmatchcase(p.name, pattern))


def schema_of(table: str | Path) -> str:
    """Columns and types of a Parquet file, or of a folder of part files (those of its first), from the footer alone."""
    from pyarrow import parquet

    path = Path(table)
    if path.is_dir():
        path = min(p for p in path.iterdir() if p.name.startswith("part-"))
    return str(parquet.read_schema(path).remove_metadata())


def targets(files: Iterable[Path], out_dir: str | Path | None, ext: str) -> list[tuple[Path, Path]]:
    """Each file with its result: beside it, or flat in ``out_dir``. Two files with one result are an error."""
    pairs = [(f, (f.parent if out_dir is None else Path(out_dir)) / f"{f.stem}.{ext}") for f in files]
    by_target = defaultdict(list)
    for f, t in pairs:
        by_target[t].append(f)
    clashes = [f"  {', '.join(map(str, fs))} all map to {t}" for t, fs in by_target.items() if len(fs) > 1]
    if clashes:
        raise ValueError("duplicate output files:\n" + "\n".join(clashes))
    return pairs


def largest_first(paths: Iterable[str | Path]) -> list[str]:
    """So that a long file is not what the others wait for."""
    return sorted(map(str, paths), key=lambda p: (-Path(p).stat().st_size, p))
