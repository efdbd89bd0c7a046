"""A file of its own for each source: ``df.write.format("file_each")``, a sink that commits in two phases.

Rows carry the path of their file in a column. A task writes each run of rows with one path to a file in a hidden folder
beside its place; the driver moves all of them when every task has ended well, and deletes them when one has not. So
a reader never sees part of a file, and a lost executor or a task that runs twice leaves nothing behind. Memory is a
batch of rows, whatever the file's size.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute is not there without it)
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import prepare

#: The column that holds the path.
TARGET = "__target"
#: Rows of a row group, which are in memory at once.
GROUP = 128 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


@dataclass
class Written(WriterCommitMessage):
    #: (draft, target, rows) of each file of a task.
    files: list[tuple[str, str, int]]


def note(folder: str, source: str, target: str, reason: object) -> None:
    """Notes in a shared folder that a source could not be read."""
    own, where = opened(f"{folder}/{uuid.uuid4().hex}.json")
    own.create_dir(posixpath.dirname(where), recursive=True)
    with own.open_output_stream(where) as out:
        out.write(json.dumps({"source": source, "target": target, "reason": str(reason)}).encode())


def noted(folder: str | None) -> list[dict]:
    """What was noted, by source; what a task noted again when it ran again counts once."""
    own, where = opened(folder) if folder else (None, "")
    if not own or own.get_file_info(where).type == fs.FileType.NotFound:
        return []
    found = {}
    for info in own.get_file_info(fs.FileSelector(where)):
        with own.open_input_stream(info.path) as f:
            entry = json.loads(f.read())
        found[entry["source"]] = entry
    return [found[k] for k in sorted(found)]


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.schema = StructType([f for f in schema.fields if f.name != TARGET])
        if len(self.schema) == len(schema):
            raise ValueError(f"rows have no column {TARGET}")
        self.job = uuid.uuid4().hex
        #: Files that shall be there, with rows or without.
        self.expected = json.loads(options.get("expected", "[]"))
        #: A folder where sources note files that they could not read: what came of these is not committed.
        self.failures = options.get("failures")

    def _folder(self, target: str) -> str:
        return f"{posixpath.dirname(target)}/_writing-{self.job}"

    def _draft(self, target: str) -> str:
        return f"{self._folder(target)}/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, target, out = [], None, None
        try:
            for batch in batches:
                at = batch.schema.get_field_index(TARGET)
                ends = pa.compute.run_end_encode(batch.column(at).cast(pa.string()))
                rows, start = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], [n for i, n in enumerate(batch.schema.names) if i != at]), 0
                for end, path in zip(ends.run_ends.to_pylist(), ends.values.to_pylist()):
                    if path is None:
                        raise ValueError(f"{TARGET} is null")
                    part = rows.slice(start, end - start)
                    if path != target:
                        if out:
                            out.close()
                        target, (own, where) = path, opened(draft := self._draft(path))
                        own.create_dir(posixpath.dirname(where), recursive=True)
                        out = parquet.ParquetWriter(where, part.schema, filesystem=own, compression="snappy")
                        done.append([draft, path, 0])
                    out.write_batch(part, row_group_size=GROUP)
                    done[-1][2] += part.num_rows
                    start = end
            if out:
                out.close()
        except BaseException:
            self._delete(d for d, _, _ in done)
            raise
        return Written([tuple(x) for x in done])

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        places = [t for _, t, _ in files]
        if twice := sorted({t for t in places if places.count(t) > 1} if len(set(places)) < len(places) else ()):
            raise ValueError(f"rows of one file came in several runs; sort them by {TARGET} first: {', '.join(twice[:5])}")
        failed = {x["target"] for x in noted(self.failures)}
        for target in sorted(set(self.expected) - set(places) - failed):
            own, where = opened(draft := self._draft(target))
            own.create_dir(posixpath.dirname(where), recursive=True)
            parquet.write_table(to_arrow_schema(self.schema).empty_table(), where, filesystem=own)
            files.append((draft, target, 0))
        for draft, target, _ in files:
            if target not in failed:
                own, where = opened(draft)
                own.move(where, opened(target)[1])
        self._forget(files)

    def abort(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        self._delete(d for d, _, _ in files)
        # what a task that was killed left is in the same folders
        self._forget([*files, *((None, t, 0) for t in self.expected)])

    def _forget(self, files: list[tuple]) -> None:
        for folder in {self._folder(t) for _, t, _ in files}:
            own, where = opened(folder)
            if own.get_file_info(where).type != fs.FileType.NotFound:
                own.delete_dir(where)

    def _delete(self, drafts) -> None:
        for draft in drafts:
            own, where = opened(draft)
            if own.get_file_info(where).type != fs.FileType.NotFound:
                own.delete_file(where)


class FileEach(DataSource):
    """``df.write.format("file_each")``: rows with a column ``__target``, those of one path side by side in one
    partition, become one Parquet file at that path. Option ``expected``: a JSON list of paths that get an empty file where no row
    has them. Files that are there are replaced."""

    @classmethod
    def name(cls) -> str:
        return "file_each"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, dict(self.options))


def write_each(df: DataFrame, expected: list[str] = (), ordered: bool = False, failures: str | None = None) -> None:
    """Writes the rows of ``df`` to the files of its column ``__target``, in one job.

    ``ordered``: the rows of each file already are side by side in one partition, as they come from a source that reads a
    file in one go; nothing is shuffled then. Otherwise a file's rows are brought together, in no stated order.
    ``failures``: the folder where the source notes what it could not read."""
    spark = prepare(df.sparkSession)
    spark.dataSource.register(FileEach)
    rows = df if ordered else df.repartition(TARGET).sortWithinPartitions(TARGET)
    out = rows.write.format("file_each").mode("append").option("expected", json.dumps(list(expected)))
    (out.option("failures", failures) if failures else out).save()


def write_one(df: DataFrame, path: str) -> None:
    """Writes a table as one file, in its order. One task writes it, a row group at a time."""
    # ranges of a sorted table are read one after the other by the last task
    write_each(df.coalesce(1).withColumn(TARGET, F.lit(str(path))), [str(path)], ordered=True)
