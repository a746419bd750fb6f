"""The first rows of an order from few files: items laid out by each order, with the bounds of every file in a table.

A layout is a copy of the active items, sorted and cut into files of a bounded number of rows; rising and falling orders of the same columns
share it. Keys end with the item's id, so files of one write do not overlap and no key is hot. A reader takes files from
the best bound on and stops as soon as its last row is ahead of the next file's bound: without filters the bounds alone
tell which files that needs, with filters the rows found so far do, and the number of files doubles until they suffice. A filter that few
items meet ends at reading all files, about twice in sum.

Changed items become a segment of their own, whose files overlap those of others; their older copies count as gone and are taken out where a
file is read. ``compact`` lays everything out anew. All of it changes by entries of a commit log, so a reader sees one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.workers import stored
from .commits import CommitLog, Entry, retried
from .filters import active
from .search import SORTS, sort_columns

ROWS_PER_FILE = 1 << 16
#: Bounds that are fetched at a time, best first.
BOUNDS = 64
SEGMENT = "_segment"


def layout(mode: str) -> tuple[str, tuple[str, ...], bool]:
    """(name of the layout, its columns, whether the order falls)."""
    columns = tuple(c.lstrip("-") for c in SORTS[mode])
    return columns[0], columns, SORTS[mode][0].startswith("-")


def _key(values: Iterable) -> tuple:
    """A key as Spark orders it: nulls before all values."""
    return tuple((v is not None, v) for v in values)


@dataclass
class Top:
    rows: DataFrame
    #: files that ``rows`` are read from
    files: list[str]


class RankFiles:
    """Layouts of items in the folder of a commit log. Items have scores (``with_scores``), those of the moment at which they were stored."""

    def __init__(self, log: CommitLog):
        self.log, self._heads = log, {}

    def _write(self, name: str, columns: tuple[str, ...], rows: DataFrame, segment: int, files: int) -> dict[str, dict[str, str]]:
        rows = rows.withColumn(SEGMENT, F.lit(segment))
        part = self.log.write(name, rows.repartitionByRange(files, *columns).sortWithinPartitions(*columns), str(segment))
        folder = part[str(segment)]
        there = self.log.spark.read.schema(rows.schema).parquet(f"{self.log.path}/{folder}")
        key = F.struct(*columns)
        bounds = there.groupBy(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
        bounds = bounds.repartition(1)  # a row a file
        return {name: part, f"{name}_bounds": self.log.write(f"{name}_bounds", bounds, str(segment))}

    def _schemas(self, items: DataFrame, names: dict[str, tuple[str, ...]]) -> dict:
        rows = items.withColumn(SEGMENT, F.lit(0))
        key = lambda c: F.struct(*c)
        bounds = {f"{n}_bounds": rows.select(F.lit("").alias("file"), key(c).alias("low"), key(c).alias("high"), F.lit(0).cast("long").alias("rows")).schema for n, c in names.items()}
        return {n: rows.schema for n in names} | bounds | {"gone": items.select("item_id", F.lit(0).alias("before")).schema}

    def build(self, items: DataFrame, modes: Iterable[str] = tuple(SORTS), per_file: int = ROWS_PER_FILE) -> Entry:
        """Lays out active items for ``modes``, in place of what was there."""
        names = {layout(m)[0]: layout(m)[1] for m in modes}
        items = active(items)
        files = max(1, -(-items.count() // per_file))

        def attempt() -> Entry:
            base = self.log.head()
            changes = {t: {p: None for p in parts} for t, parts in base.tables.items() if t == "gone" or t.removesuffix("_bounds") in names}
            for name, columns in names.items():
                for table, part in self._write(name, columns, items, base.number + 1, files).items():
                    changes[table] = changes.get(table, {}) | part
            return self.log.commit(base, changes, self._schemas(items, names), per_file=per_file)

        return retried(attempt)

    def update(self, changed: DataFrame) -> Entry:
        """Takes the present state of changed and of new items, one row an item; those that are not active leave the layouts."""
        changed = stored(changed)
        rows = active(changed).count()

        def attempt() -> Entry:
            base = self.log.head()
            files = max(1, -(-rows // int(base.notes["per_file"])))
            segment, changes = base.number + 1, {}
            for name in [n for n in base.tables if f"{n}_bounds" in base.tables]:
                columns = next(c for n, c, _ in map(layout, SORTS) if n == name)
                order = [f["name"] for f in base.schemas[name]["fields"] if f["name"] != SEGMENT]
                changes |= self._write(name, columns, active(changed).select(*order), segment, files)
            changes["gone"] = self.log.write("gone", changed.select("item_id", F.lit(segment).alias("before")), str(segment))
            return self.log.commit(base, changes)

        return retried(attempt)

    def compact(self) -> Entry:
        """Lays out all live items anew, without older copies."""
        base = self.log.head()
        names = [n for n in base.tables if f"{n}_bounds" in base.tables]
        live = self._live(base, self.log.read(names[0], base)).drop(SEGMENT)
        return self.build(live, [m for m in SORTS if layout(m)[0] in names], int(base.notes["per_file"]))

    def _live(self, at: Entry, rows: DataFrame) -> DataFrame:
        if not at.tables.get("gone"):
            return rows
        gone = self.log.read("gone", at).groupBy(F.col("item_id").alias("_gone")).agg(F.max("before").alias("_before"))
        return rows.join(gone, (F.col("item_id") == F.col("_gone")) & (F.col(SEGMENT) < F.col("_before")), "left_anti")

    def _head(self, at: Entry, mode: str, n: int) -> list[tuple]:
        """At least ``n`` files (file, near bound, far bound, rows) from the best on, or all."""
        if self._heads.get("entry") != at.number:
            self._heads = {"entry": at.number}
        have, everything = self._heads.get(mode, ([], False))
        if len(have) < n and not everything:
            name, _, falling = layout(mode)
            near, far = ("high", "low") if falling else ("low", "high")
            asked = max(BOUNDS, 2 * n)
            best = self.log.read(f"{name}_bounds", at).orderBy(F.col(near).desc() if falling else F.col(near), "file").limit(asked)
            have = [(r["file"], _key(r[near]), _key(r[far]), r["rows"]) for r in best.collect()]
            self._heads[mode] = have, len(have) < asked
        return have

    def count(self, mode: str) -> int:
        """Rows of a layout, by the bounds alone; older copies of changed items count until ``compact``."""
        return self.log.read(f"{layout(mode)[0]}_bounds").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def first(self, mode: str, k: int, offset: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None) -> Top:
        """The rows after ``offset`` of an order, ``k`` at most, of all items or of those that ``keep`` leaves."""
        at = self.log.head()
        name, columns, falling = layout(mode)
        schema = StructType.fromJson(at.schemas[name])
        order, need = sort_columns(mode), offset + k
        ahead = lambda a, b: a >= b if falling else a <= b
        n = 1
        while True:  # files by their bounds
            head = self._head(at, mode, n + 1)
            if len(head) <= n or sum(rows for _, _, far, rows in head[:n] if ahead(far, head[n][1])) >= need:
                break
            n += 1
        while True:
            head = self._head(at, mode, n + 1)
            files = [f for f, *_ in head[:n]]
            rows = self.log.spark.read.schema(schema).parquet(*(f"{self.log.path}/{f}" for f in files)) if files else self.log.spark.createDataFrame([], schema)
            rows = self._live(at, rows)
            rows = (keep(rows) if keep else rows).drop(SEGMENT)
            if len(head) <= n or (keep is None and not at.tables.get("gone")):
                break
            last = rows.select(*columns).orderBy(*order).offset(need - 1).limit(1).first()
            if last is not None and ahead(_key(last), head[n][1]):
                break
            n *= 2
        return Top(rows.orderBy(*order).offset(offset).limit(k), files)
