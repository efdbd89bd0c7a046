"""Layouts of source files: built-in presets, TOML files, single overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class NrtLayout:
    """Near-real-time files: TIME x DEPTH, one platform a file."""

    has_deph_source: bool = False
    has_profile_coords: bool = False
    pattern: str | None = None


@dataclass(frozen=True)
class CoraLayout:
    """Reanalysis files: N_PROF x N_LEVELS, a platform per profile."""

    time_var: str = "TIME"
    qc_type: str = "Int"
    has_time_qc: bool = True
    has_deph_source: bool = True
    pattern: str | None = None

    def __post_init__(self):
        if self.qc_type not in ("Int", "Char"):
            raise ValueError(f"qc_type {self.qc_type!r}; known are Int and Char")


#: Presets and the file names that a batch takes by default.
PRESETS: dict[str, NrtLayout | CoraLayout] = {
    "nrt_ar": NrtLayout(False, False),
    "nrt_bo": NrtLayout(True, True),
    "nrt_mo": NrtLayout(False, False),
    "nrt_gl": NrtLayout(True, False),
    "cora": CoraLayout(),
    "cora_legacy": CoraLayout("JULD", "Char", False, False),
}
PATTERNS = {"nrt_ar": "AR_PR_CT_*.nc", "nrt_bo": "BO_PR_CT_*.nc", "nrt_mo": "MO_PR_CT_*.nc", "nrt_gl": "GL_PR_CT_*.nc", "cora": "*.nc", "cora_legacy": "*.nc"}


def layout(preset: str, config: str | Path | None = None, **flags) -> NrtLayout | CoraLayout:
    """Preset, then a TOML file (every field but pattern must be in it), then flags that are not None."""
    if preset not in PRESETS:
        raise ValueError(f"preset {preset!r}; known are {', '.join(PRESETS)}")
    out = PRESETS[preset]
    if config is not None:
        with open(config, "rb") as f:
            given = tomllib.load(f)
        names = [x.name for x in fields(out)]
        lacking = [n for n in names if n != "pattern" and n not in given]
        if lacking:
            raise ValueError(f"{config}: missing {', '.join(lacking)}")
        out = type(out)(**{k: v for k, v in given.items() if k in names})
    return replace(out, **{k: v for k, v in flags.items() if v is not None})
