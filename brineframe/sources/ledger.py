"""Tables that grow by numbered batches in a folder, with idempotent commits that can't lose an update.

A batch sees the state as it was when it began, up to the number ``base``. What it writes lies in
``<path>/<table>/seq=<base + 1>/try=<its own id>``, which no other writer touches. It counts once the file
``<path>/commits/<base + 1>`` is there, with its name and id: a finished file that is renamed to that place, and only
if nothing is there. So whoever commits second finds the number taken, though both saw the same state, and begins
anew on top of the other's batch. A batch that failed leaves folders that no one reads.

The file system must rename files atomically, as HDFS does; on a store that can't, use one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a batch's name.
NAME = 100
#: How often a batch begins anew because another one was committed meanwhile.
TRIES = 20


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[int, tuple[str, str]] = {}

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return where.getFileSystem(self._conf()), where

    def _exists(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where)

    def _content(self, path: str) -> dict:
        files, where = self._at(path)
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _published(self, path: str, content: dict) -> bool:
        """Puts a whole file at a place where none is; False, and no change, if there is one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        to = hadoop.Path(f"{self.path}/{path}")
        files.mkdirs(to.getParent())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_over[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self._conf()).rename(draft, to, never_over)
            return True
        except Exception:
            files.delete(draft, False)
            if files.exists(to):
                return False
            raise

    def commits(self) -> dict[int, tuple[str, str]]:
        """Name and id of each committed batch by number (a small file per batch comes to the driver, once)."""
        files, where = self._at("commits")
        if files.exists(where):
            for n in {int(x.getPath().getName()) for x in files.listStatus(where)} - self._known.keys():
                found = self._content(f"commits/{n}")
                self._known[n] = found["name"], found["id"]
        return dict(self._known)

    def fixed(self, name: str, value: int) -> int:
        """A number that holds for the whole ledger: that of the first call."""
        if not self._exists(f"fixed/{name}"):
            self._published(f"fixed/{name}", {"value": value})
        return self._content(f"fixed/{name}")["value"]

    def begin(self, name: str) -> Batch | None:
        """A batch on top of what is committed now; None if one of that name is."""
        if len(name.encode()) > NAME:
            raise ValueError(f"a batch's name has up to {NAME} bytes")
        state = self.commits()
        return None if any(name == known for known, _ in state.values()) else Batch(self, name, state)

    def apply(self, name: str, work: Callable[[Batch], None]) -> bool:
        """Commits what ``work`` writes into a batch, begun anew for as long as others commit meanwhile. False if a batch of
        that name was committed before."""
        for _ in range(TRIES):
            if (batch := self.begin(name)) is None:
                return False
            work(batch)
            if batch.commit():
                return True
        raise RuntimeError(f"{TRIES} other batches were committed while {name!r} was applied")

    def read(self, table: str, schema: str, by: str | None = None, some: Iterable[int] | None = None, of: dict[int, tuple[str, str]] | None = None) -> DataFrame:
        """Rows of a table in the batches ``of`` (all that are committed) with their ``seq``; with ``some``, no file is opened but
        those of these values of ``by``."""
        chosen = self.commits() if of is None else of
        paths = [f"{self.path}/{p}" for n, (_, own) in sorted(chosen.items()) if self._exists(p := f"{table}/seq={n}/try={own}")]
        full = T._parse_datatype_string(schema).add("seq", T.IntegerType())
        if not paths:
            return self.spark.createDataFrame([], full)
        folders = T._parse_datatype_string(schema).add("seq", T.IntegerType()).add("try", T.StringType())
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").schema(folders).parquet(*paths).drop("try")
        return rows if some is None else rows.where(F.col(by).isin(list(some)))


class Batch:
    """What one writer adds on top of the state ``state``; nothing of it counts before ``commit``."""

    def __init__(self, log: Ledger, name: str, state: dict[int, tuple[str, str]]):
        self.log, self.name, self.state = log, name, state
        self.seq, self.id = max(state, default=-1) + 1, uuid.uuid4().hex

    def write(self, table: str, df: DataFrame, by: str | None = None) -> None:
        """``by``: a column of whole numbers; each of its values is a folder that reads may pick."""
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.log.path}/{table}/seq={self.seq}/try={self.id}")

    def read(self, table: str, schema: str, by: str | None = None, some: Iterable[int] | None = None) -> DataFrame:
        """The table as it was when the batch began."""
        return self.log.read(table, schema, by, some, self.state)

    def own(self, table: str, schema: str) -> DataFrame:
        """What this batch wrote."""
        return self.log.read(table, schema, of={self.seq: (self.name, self.id)})

    def commit(self) -> bool:
        """False if another batch was committed since this one began."""
        return self.log._published(f"commits/{self.seq}", {"name": self.name, "id": self.id})
