"""Shared helpers: the shared folder for intermediate tables, word hashing, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import lowest

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that Python workers get at a time, where the session has Spark's default of 10000: whole texts may be long.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def with_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the driver found it through ``sys.path`` only, and bounds what they get at a time."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, the folder that driver and executors share.

    A name without a scheme belongs to Hadoop's default file system. Where the setting is missing, a local session uses a folder of
    this machine; on a cluster that is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "spark-shared")
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_written: list[str] = []  # folders of tables that were not deleted yet


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_table_path", None):
            _delete(df.sparkSession, path)


def settle(df: DataFrame, before: int) -> DataFrame:
    """Materialises ``df`` and deletes all tables written since ``written()`` was ``before``, which it was made from."""
    df = materialise(df)
    for path in _written[before:-1]:
        _delete(df.sparkSession, path)
    return df


def written() -> int:
    return len(_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column has it: columns of a caller may have any names."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


# ---------------------------------------------------------------- words as 64-bit hashes

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_SPAN = 1 << 19  # bytes of texts taken at a time; a longer text is taken whole
_rng = np.random.Generator(np.random.PCG64(20240601))
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP = None
_DOWN = None


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes that are no part of a word: blank, tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: all ASCII but letters and digits.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of an Arrow string column; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hash_span(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices (in order) of ``raw``, by its prefix sums; runs of about ``_SPAN`` bytes at a time, whatever its length."""
    global _UP, _DOWN
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, first + _SPAN)))
        part, at, to = raw[first : int(ends[i:j].max())], starts[i:j] - first, ends[i:j] - first
        n = len(part)
        if _UP is None or len(_UP) < n:
            size = max(n, _SPAN + (1 << 16))
            up, down = _powers(int(_P), size), _powers(pow(int(_P), -1, 1 << 64), size)
            if size <= 2 * _SPAN:  # kept for later; those of a very long word are not
                _UP, _DOWN = up, down
        else:
            up, down = _UP, _DOWN
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LETTER[part] * up[:n], out=total[1:])
        out[i:j] = mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64))
        i = j
    return out


def _lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters of two bytes that begin with 0xC3."""
    low = _LOWER[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    wide = wide[(raw[wide] >= 0x80) & (raw[wide] <= 0x9E) & (raw[wide] != 0x97)]
    low[wide] += 32
    return low


class Words:
    """All words of a run of texts: ``hash``, and the slice ``at[i]:at[i + 1]`` of text ``i``."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, gap: np.ndarray = BLANK, latin: bool = False):
        n = len(at) - 1
        low = _lower_latin(raw) if latin else _LOWER[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = ~gap[low]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside[:-1]
        before[at] = False  # a text begins
        first = inside & ~before
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[:-1] = inside[1:]
        cut = at[1:] - 1
        after[cut[cut >= 0]] = False
        last = inside & ~after
        starts, ends = np.flatnonzero(first[:-1]), np.flatnonzero(last[:-1]) + 1
        self.at = np.searchsorted(starts, at)
        if n:
            self.at[-1] = len(starts)
        self.hash = _hash_span(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.starts, self.ends, self.low = starts, ends, low

    def stems(self, n: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words of at least ``longer`` bytes, and those words' places."""
        long = np.flatnonzero(self.ends - self.starts >= longer)
        if not len(long):
            return np.zeros(0, np.uint64), long
        return _hash_span(self.low, self.starts[long], self.starts[long] + n), long


def chunks(texts: pa.Array, span: int = _SPAN):
    """Splits a column into runs of whole texts of about ``span`` bytes: (first row, bytes, offsets)."""
    raw, at = string_buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + span, side="right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc only


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


# ---------------------------------------------------------------- connected components

def _forest(batches):
    """Keeps of a task's edges only a spanning forest; every vertex points to the smallest of its tree."""
    held, size = [], 0

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        a, b = np.concatenate(parts, axis=1)
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = lowest(len(ids), at[: len(a)], at[len(a) :])
        some = np.flatnonzero(low != np.arange(len(ids)))
        return np.stack([ids[some], ids[low[some]]])

    def out(edges: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        size += batch.num_rows
        if size > 1 << 18:
            held = [reduced(held)]
            size = held[0].shape[1]
            if size > 1 << 17:
                yield out(held[0])
                held, size = [], 0
    if held:
        yield out(reduced(held))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges(a, b)``; component is the smallest id reachable.

    ``forget`` deletes the table behind the result. Each task first reduces its own edges to a forest. Then large-star and small-star steps alternate, each a
    grouped minimum and a join, so that a vertex with very many neighbours needs no list of them; every round is
    written to the shared folder. The rounds grow with the logarithm of the longest path, not with the data.
    """
    with_workers(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialise(now.mapInArrow(_forest, "a long, b long").where("a <> b").distinct())
    seen = None
    while True:
        # large star: every neighbour above v hangs below the smallest around v. The minima are a table of their own, so that
        # Spark can split the partition of a vertex with very many neighbours in the join.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the same with the neighbours below v, and v itself
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = (
            small.where("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        new = materialise(new)
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(low)
        forget(now)
        now = new
        if mark == seen:
            break
        seen = mark
    tops = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
    out._table_path = now._table_path
    return out
