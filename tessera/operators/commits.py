"""Tables that change together: parts in folders, and a log whose entries name the parts of every table.

A table consists of parts, each a folder of Parquet files that is never changed. An entry of the log names all parts of all tables, so a
reader of one entry sees one state of all of them, and what was written but not committed is seen by nobody. A commit is based on
the entry it read and creates the next number; the file system lets one writer only create it, another gets ``Conflict`` and starts again.

``merge_parts`` splits a table by ranges of ids and reads and writes only the parts that a batch touches: the others stay, by name and by
file. Entries hold the names of parts, so their size grows with the number of parts, not of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.workers import PACKED

#: Ids of one part of a table split by ids.
WIDTH = 1 << 20
PART = "_part"


class Conflict(Exception):
    """Another writer committed first."""


@dataclass
class Entry:
    number: int = -1
    #: folders by table and part
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    #: what writers keep for themselves, such as the last epoch of a stream
    notes: dict[str, object] = field(default_factory=dict)


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("log").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def head(self) -> Entry:
        """The newest entry; an empty one before the first commit."""
        found = self.fs.globStatus(self._at("log/*.json")) or ()
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in found]
        return self.entry(max(numbers)) if numbers else Entry()

    def entry(self, number: int) -> Entry:
        source = self.fs.open(self._at(f"log/{number:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return Entry(number, **json.loads(text))

    def read(self, name: str, at: Entry | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table as an entry (the newest) has it, or some of its parts."""
        at = at or self.head()
        schema = StructType.fromJson(at.schemas[name])
        folders = [f"{self.path}/{f}" for p, f in at.tables.get(name, {}).items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, part: str = "all") -> dict[str, str]:
        """Writes a part of a table and returns it for ``commit``; nobody reads it before."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}", compression=PACKED)
        return {part: folder}

    def write_parts(self, name: str, df: DataFrame, part: Column) -> dict[str, str]:
        """Writes ``df`` split by ``part``, a task for each part, and returns the parts."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.withColumn(PART, part).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        found = self.fs.globStatus(self._at(f"{folder}/{PART}=*")) or ()
        names = [x.getPath().getName() for x in found]
        return {n.removeprefix(f"{PART}="): f"{folder}/{n}" for n in names}

    def commit(self, base: Entry, changes: dict[str, dict[str, str | None]], schemas: dict[str, StructType] | None = None, **notes) -> Entry:
        """The entry after ``base`` with parts added, replaced or (None) left out, in all tables at once."""
        tables = {name: dict(parts) for name, parts in base.tables.items()}
        for name, parts in changes.items():
            mine = tables.setdefault(name, {})
            for part, folder in parts.items():
                if folder is None:
                    mine.pop(part, None)
                else:
                    mine[part] = folder
        new = Entry(base.number + 1, tables, base.schemas | {n: s.jsonValue() for n, s in (schemas or {}).items()}, base.notes | notes)
        text = json.dumps({"tables": new.tables, "schemas": new.schemas, "notes": new.notes})
        temp, final = self._at(f"log/_{uuid.uuid4().hex}"), self._at(f"log/{new.number:012d}.json")
        sink = self.fs.create(temp, True)
        sink.write(bytearray(text.encode()))
        sink.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE  # an existing entry is not replaced
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(temp), self.fs.makeQualified(final), options)
        except Exception as e:
            self.fs.delete(temp, False)
            if self.fs.exists(final):
                raise Conflict(f"entry {new.number} exists") from e
            raise
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Deletes parts that none of the newest ``keep`` entries names; returns their number. Writers must not be at work meanwhile."""
        head = self.head()
        used = {f for n in range(max(0, head.number - keep + 1), head.number + 1) for parts in self.entry(n).tables.values() for f in parts.values()}
        old = {f for n in range(head.number + 1) for parts in self.entry(n).tables.values() for f in parts.values()} - used
        return sum(bool(self.fs.delete(self._at(f), True)) for f in sorted(old))


def id_part(column: str = "item_id", width: int = WIDTH) -> Column:
    return F.floor(F.coalesce(column, F.lit(0)) / width).cast("string")


def create_parts(log: CommitLog, name: str, df: DataFrame, part: Column) -> Entry:
    """Stores ``df`` as a new table of the group."""
    return log.commit(log.head(), {name: log.write_parts(name, df, part)}, {name: df.schema})


def merge_parts(log: CommitLog, base: Entry, name: str, keys: DataFrame, part: Column, merge: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, str | None], list[str]]:
    """(changes for ``commit``, parts touched): ``merge`` gets the rows of the parts in which ``keys`` (with the columns of ``part``) lie and returns their next state."""
    touched = sorted(r[0] for r in keys.select(part.alias(PART)).distinct().collect())  # names of parts, not rows
    old = log.read(name, base, touched)
    new = log.write_parts(name, merge(old).select(*old.columns), part)
    return {p: None for p in touched} | new, touched


def retried(attempt: Callable[[], Entry], times: int = 5) -> Entry:
    """Runs ``attempt``, which reads the head and commits, again after conflicts."""
    for k in range(times):
        try:
            return attempt()
        except Conflict:
            if k + 1 == times:
                raise
    raise PySparkException("no attempt")
