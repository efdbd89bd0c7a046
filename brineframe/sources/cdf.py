"""Reader and writer for the classic NetCDF formats (CDF-1, CDF-2, CDF-5), as published.

HDF5-based NetCDF-4 files need the optional netCDF4 or h5netcdf packages.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field
from pathlib import Path
from typing import BinaryIO

import numpy as np

#: External types by number.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NAMES = {1: "Int(I8)", 2: "Char", 3: "Int(I16)", 4: "Int(I32)", 5: "Float(F32)", 6: "Float(F64)", 7: "Int(U8)", 8: "Int(U16)", 9: "Int(U32)", 10: "Int(I64)", 11: "Int(U64)"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: int
    attributes: dict = field(default_factory=dict)
    begin: int = 0
    data: np.ndarray | None = None

    @property
    def type_name(self) -> str:
        return NAMES[self.kind]


class ClassicFile:
    """Dimensions, attributes and variables of a classic file; slices along the first dimension are read alone.
    ``content``: the file's bytes, where it can't be opened by its path."""

    def __init__(self, path: str | Path, content: bytes | None = None):
        self.path, self._content = str(path), content
        with self._opened() as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path}: not a classic NetCDF file")
            self._long = magic[3] == 5
            self._offset = ">i4" if magic[3] == 1 else ">i8"
            self.records = self._count()
            if self.records < 0 or self.records in (0xFFFFFFFF,):
                raise ValueError(f"{path}: files that are still being written are not supported")
            dims = self._list(DIMENSIONS, lambda: (self._name(), self._count()))
            self.dimensions = {n: (size or self.records) for n, size in dims}
            self._record = next((n for n, size in dims if size == 0), None)
            names = [n for n, _ in dims]
            self.attributes = dict(self._list(ATTRIBUTES, self._attribute))
            variables = self._list(VARIABLES, lambda: self._variable(names))
            self.variables = {v.name: v for v in variables}
        rows = [v for v in variables if v.dims and v.dims[0] == self._record]
        sizes = [self._row_bytes(v) for v in rows]
        self._stride = sizes[0] if len(rows) == 1 else sum(-(-s // 4) * 4 for s in sizes)

    def _opened(self) -> BinaryIO:
        return open(self.path, "rb") if self._content is None else io.BytesIO(self._content)

    def _read(self, kind: str, n: int = 1) -> np.ndarray:
        own = np.dtype(kind)
        return np.frombuffer(self._f.read(own.itemsize * n), own)

    def _count(self) -> int:
        return int(self._read(">i8" if self._long else ">i4")[0])

    def _name(self) -> str:
        n = self._count()
        return self._f.read(-(-n // 4) * 4)[:n].decode()

    def _list(self, tag: int, read) -> list:
        found, n = int(self._read(">i4")[0]), self._count()
        if found not in (0, tag):
            raise ValueError(f"{self.path}: damaged header")
        return [read() for _ in range(n)]

    def _attribute(self) -> tuple[str, object]:
        name, kind, n = self._name(), int(self._read(">i4")[0]), self._count()
        own = np.dtype(TYPES[kind])
        raw = self._f.read(-(-own.itemsize * n // 4) * 4)[: own.itemsize * n]
        if kind == 2:
            return name, raw.decode("utf-8", "replace").rstrip("\0")
        values = np.frombuffer(raw, own).tolist()
        return name, values[0] if n == 1 else values

    def _variable(self, names: list[str]) -> Variable:
        name = self._name()
        dims = tuple(names[self._count()] for _ in range(self._count()))
        attributes = dict(self._list(ATTRIBUTES, self._attribute))
        kind = int(self._read(">i4")[0])
        self._count()  # its size, which is not reliable for large variables
        return Variable(name, dims, kind, attributes, int(self._read(self._offset)[0]))

    def _row_bytes(self, v: Variable) -> int:
        return int(np.prod([self.dimensions[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize

    def read(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Rows start to stop of the first dimension, in native byte order."""
        v = self.variables[name]
        own = np.dtype(TYPES[v.kind])
        with self._opened() as f:
            if not v.dims:
                f.seek(v.begin)
                return np.frombuffer(f.read(own.itemsize), own).reshape(()).astype(own.newbyteorder("="))
            size = self.dimensions[v.dims[0]]
            stop = size if stop is None else min(stop, size)
            shape = (max(stop - start, 0), *(self.dimensions[d] for d in v.dims[1:]))
            row = self._row_bytes(v)
            if v.dims[0] == self._record:
                parts = []
                for k in range(start, stop):
                    f.seek(v.begin + k * self._stride)
                    parts.append(f.read(row))
                raw = b"".join(parts)
            else:
                f.seek(v.begin + start * row)
                raw = f.read(row * shape[0])
        return np.frombuffer(raw, own).reshape(shape).astype(own.newbyteorder("="))


def write_classic(path: str | Path, dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> None:
    Path(path).write_bytes(classic_bytes(dimensions, variables, attributes))


def classic_bytes(dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A CDF-2 file with fixed dimensions; for fixtures and small exports."""
    kinds = {np.dtype("i1"): 1, np.dtype("S1"): 2, np.dtype("i2"): 3, np.dtype("i4"): 4, np.dtype("f4"): 5, np.dtype("f8"): 6}
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def attribute(name: str, value) -> bytes:
        if isinstance(value, str):
            return text(name) + struct.pack(">ii", 2, len(value.encode())) + pad(value.encode())
        values = np.atleast_1d(value)
        kind = kinds[values.dtype]
        return text(name) + struct.pack(">ii", kind, len(values)) + pad(values.astype(TYPES[kind]).tobytes())

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    names = list(dimensions)
    head = b"CDF\x02" + struct.pack(">i", 0) + listed(DIMENSIONS, [text(n) + struct.pack(">i", s) for n, s in dimensions.items()]) + listed(ATTRIBUTES, [attribute(k, v) for k, v in (attributes or {}).items()])
    blocks, heads = [], []
    for name, (dims, data, own) in variables.items():
        kind = kinds[np.asarray(data).dtype]
        raw = pad(np.asarray(data).astype(TYPES[kind]).tobytes())
        blocks.append(raw)
        heads.append((text(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", names.index(d)) for d in dims) + listed(ATTRIBUTES, [attribute(k, v) for k, v in own.items()]) + struct.pack(">ii", kind, len(raw))))
    begin = len(head) + 8 + sum(len(h) + 8 for h in heads)
    out = [head, struct.pack(">ii", VARIABLES if heads else 0, len(heads))]
    for h, raw in zip(heads, blocks):
        out.append(h + struct.pack(">q", begin))
        begin += len(raw)
    return b"".join(out + blocks)


def open_grid(path: str | Path, content: bytes | None = None):
    """A classic file, or (with the netCDF4 package) any other NetCDF file, behind the same few methods."""
    if content is None:
        with open(path, "rb") as f:
            classic = f.read(3) == b"CDF"
    else:
        classic = content[:3] == b"CDF"
    if classic:
        return ClassicFile(path, content)
    try:
        import netCDF4
    except ImportError as e:
        raise ValueError(f"{path}: NetCDF-4 files need the netCDF4 package") from e
    return _LibraryFile(netCDF4.Dataset(str(path), memory=content))


class _LibraryFile:
    def __init__(self, own):
        own.set_auto_maskandscale(False)
        self._own = own
        self.dimensions = {n: len(d) for n, d in own.dimensions.items()}
        self.attributes = {n: own.getncattr(n) for n in own.ncattrs()}
        kinds = {np.dtype(TYPES[k]).newbyteorder("="): k for k in TYPES}
        self.variables = {n: Variable(n, tuple(v.dimensions), kinds.get(np.dtype(v.dtype), 2), {a: v.getncattr(a) for a in v.ncattrs()}) for n, v in own.variables.items()}

    def read(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        v = self._own.variables[name]
        return np.asarray(v[...] if not v.dimensions else v[start:stop])
