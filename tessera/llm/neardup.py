"""MinHash near-dedup with tensored banding.

A document's set holds the 64-bit hashes of its distinct word shingles. Two collections of ``m`` sub-hashes, each made of
``ROWS`` minhashes, are computed; a table key combines one sub-hash of either collection, so 2m sub-hashes serve m * m
tables. m follows from the threshold: at most ``MISS`` of the pairs at the threshold agree in no table. As a table
can only bring two documents together if they share a sub-hash of each collection, documents that share none are out
after a count over 2m narrow rows, and the others get keys for their shared sub-hashes only.

Equal sets are one class, found by their hash; only classes are compared. Buckets with the same members are compared once. Within
a bucket, in blocks, sketches (one byte of every minhash) tell which classes may belong together: what agrees with a pivot in
nearly all bytes is close to it, and ties reach as far as a pair at the threshold can lie from a close one (agreement is a
metric), so no pair above the threshold is left untied but with a chance of 1e-6. No pairs are made: a task returns one tie a class.
m of the tables are screened first and their ties followed; of the others only buckets that hold classes which these have not yet brought
together are screened, and return only what joins them, so that a large group is not tied anew by every table that it shares.
Tied classes form a cluster. Within a cluster all sets are compared exactly, in blocks of bounded size, by tasks that return
one edge a class. Connected components of those edges are the result. No bucket, cluster or number of partners is capped.

Defined results: a text that is null or without words has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; a row with a null doc_id takes part like any other, but names no component (its row gets the
smallest id of the others, or null); repeated rows and ids are copies; an empty table gives an empty result; other columns pass
through ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import deal_blocks, groups, lowest
from .common import Words, chunks, components, forget, materialise, mix, table, with_workers

ROWS = 3
MISS = 2e-5
BLOCK = 128
BLOCK_SHINGLES = 1 << 19
SCREEN = 4096  # sketches in a block
#: Up to so many classes, or ids of copies, (a few numbers each) are broadcast to the texts, which then need no shuffle.
FEW = 1_000_000
CLOSE = 0.85  # share of sketch bytes that classes close to a pivot have in common with it
SPREAD = 8192  # columns of an incidence matrix at a time

_U = np.uint64


def collections(threshold: float, miss: float = MISS) -> int:
    """m: sub-hashes in each collection."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**ROWS))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and where each text's begin; not yet distinct."""
    at, h = words.at, words.hash
    n = np.diff(at)
    full = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width):
        full = mix(full * _U(3) + h[k : k + len(full)]) if k else h[: len(full)].copy()
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[: len(full)] == owner[width - 1 :] if len(full) else np.zeros(0, bool)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(starts[-1], dtype=np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    mask = np.ones(len(out), dtype=bool)
    mask[starts[short]] = False
    out[mask] = full[inside]
    for i in short:
        x = h[at[i] : at[i] + 1]
        for k in range(1, n[i]):
            x = mix(x * _U(3) + h[at[i] + k : at[i] + k + 1])
        out[starts[i]] = mix(x + _U(n[i]))[0]
    return out, starts


def distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return np.concatenate(parts or [hashes]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _params(m: int) -> np.ndarray:
    g = np.random.Generator(np.random.PCG64(97))
    return (g.integers(0, 2**31, (2, 2 * m * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


def set_hash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number for each set, 0 for the empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + _U(0x632BE59BD9B4E019)), dtype=np.uint64)])
    n = np.diff(starts)
    return np.where(n > 0, mix(total[starts[1:]] - total[starts[:-1]] + n.astype(np.uint64)), _U(0))


def sub_hashes(hashes: np.ndarray, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """2m sub-hashes of each non-empty set (the first m are one collection, the others the second), and its sketch."""
    x, (mul, add) = (hashes >> _U(32)).astype(np.uint32), _params(m)
    out, sketch = np.zeros((len(starts) - 1, 2 * m), dtype=np.uint64), np.zeros((len(starts) - 1, 2 * m * ROWS), dtype=np.uint8)
    at = starts[:-1]
    for k in range(2 * m):
        for r in range(ROWS):
            v = np.minimum.reduceat(x * mul[k * ROWS + r] + add[k * ROWS + r], at).astype(np.uint64)
            out[:, k] = mix(out[:, k] * _U(5) + v + _U(k))
            sketch[:, k * ROWS + r] = mix(v).astype(np.uint8)
    return out, sketch


def _signer(kept: list[str], width: int, m: int):
    """Size and hash of every text's set, and, with m, its sub-hashes and its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, subs, sketches = [], [], [], []
            for _, raw, at in chunks(batch.column("text")):
                hashes, starts = distinct(*shingles(Words(raw, at), width))
                n = np.diff(starts)
                some = np.flatnonzero(n)
                sizes.append(n)
                nodes.append(set_hash(hashes, starts).view(np.int64))
                own, drawn = [None] * len(n), [None] * len(n)
                if len(some) and m:
                    found, sketch = sub_hashes(hashes, np.append(starts[some], len(hashes)), m)
                    for i, s, d in zip(some, found.view(np.int64), sketch, strict=True):
                        own[i], drawn[i] = s, d.tobytes()
                subs += own
                sketches += drawn
            empty = [np.zeros(0, np.int64)]
            made = [pa.array(np.concatenate(sizes or empty)), pa.array(np.concatenate(nodes or empty)), pa.array(subs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            made = made if m else made[:2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "n_shingles", "node", "subs", "sketch"][: len(kept) + len(made)])

    return run


def reach(threshold: float, size: int) -> tuple[int, int]:
    """(bytes that a class close to a pivot shares with it, bytes that a tied one shares) for sketches of ``size`` bytes."""
    least = threshold * size - 5 * math.sqrt(size * threshold * (1 - threshold))  # a pair at the threshold shares more, but for 5 sigma
    close = math.ceil(CLOSE * size)
    return close, math.floor(close + least - size)


def tied(sketch: np.ndarray, close: int, near: int) -> np.ndarray:
    """For every row the smallest row that ties connect it with; each pivot is compared with all rows."""
    free, left, right = np.ones(len(sketch), dtype=bool), [], []
    while free.any():
        p = int(np.argmax(free))
        same = (sketch == sketch[p]).sum(1)
        free &= same < close
        free[p] = False
        hit = np.flatnonzero(same >= near)
        left.append(np.full(len(hit), p))
        right.append(hit)
    return lowest(len(sketch), np.concatenate(left), np.concatenate(right))


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _screener(close: int, near: int):
    """Ties within the buckets of rows (key, _i, _j, node, sketch, top), between classes whose ``top`` differs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for rows in groups(batches, ("key", "_i", "_j")):
            node, top = rows["node"].to_numpy(), rows["top"].to_numpy()
            if len(node) < 2:
                continue
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            low = tied(sketch, close, near) if len(node) > 2 else np.array([0, 1 - ((sketch[0] == sketch[1]).sum() >= near)])
            some = np.flatnonzero(top != top[low])
            ends = np.unique(np.stack([top[some], top[low[some]]]), axis=1)
            left.append(ends[0])
            right.append(ends[1])
            if len(left) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_EDGES)
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_EDGES)

    return run


def _setter(width: int):
    """Sets of the texts whose set is the expected one (a repeated id may bring another text along), mostly once in a task."""
    names = ["node", "cluster", "_parts_", "set"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for batch in batches:
            for first, raw, at in chunks(batch.column("text")):
                hashes, starts = distinct(*shingles(Words(raw, at), width))
                part = batch.slice(first, len(at) - 1)
                node = part.column("node").to_numpy()
                right = np.flatnonzero(set_hash(hashes, starts).view(np.int64) == node)
                right = right[np.unique(node[right], return_index=True)[1]]
                right = right[[x not in last for x in node[right].tolist()]] if len(right) else right
                last = set(node[right].tolist())  # rows of one id come together
                sets = [hashes[starts[i] : starts[i + 1]].view(np.int64) for i in right]
                part = part.take(pa.array(right))
                cols = [part.column("node"), part.column("cluster"), part.column("_parts_"), pa.array(sets, types[3])]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(zip(names, types, strict=True))))

    return run


def _overlaps(values: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in ``left`` with those in ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    some = count[code] > 1
    code, owner = shared[code[some]], owner[some]
    row_l, row_r = np.full(len(starts), -1), np.full(len(starts), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = int(code[-1]) + 1 if len(code) else 0
    for a in range(0, width, SPREAD):
        lo, hi = np.searchsorted(code, [a, a + SPREAD])
        c, o = code[lo:hi] - a, owner[lo:hi]
        size = min(SPREAD, width - a)
        x, y = np.zeros((len(left), size), np.float32), np.zeros((len(right), size), np.float32)
        k = row_l[o] >= 0
        x[row_l[o[k]], c[k]] = 1
        k = row_r[o] >= 0
        y[row_r[o[k]], c[k]] = 1
        out += x @ y.T
    return out


def _comparer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out, right_out = [], []
        for rows in groups(batches, ("cluster", "_i", "_j")):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            node, block = rows["node"].to_numpy(), rows["_b"].to_numpy()
            sets = rows["set"].combine_chunks()
            values, n = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(n)])
            i, j = rows["_i"][0].as_py(), rows["_j"][0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            both = _overlaps(values, starts, left, right).astype(np.int64)
            union = n[left][:, None] + n[right][None, :] - both
            a, b = np.nonzero(100 * both >= percent * union)
            a, b = left[a], right[b]
            a, b = a[a != b], b[a != b]
            low = lowest(len(node), a, b)
            some = np.flatnonzero(node[low] != node)
            left_out.append(node[some])
            right_out.append(node[low[some]])
            if len(left_out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left_out)), pa.array(np.concatenate(right_out))], schema=_EDGES)
                left_out, right_out = [], []
        if left_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left_out)), pa.array(np.concatenate(right_out))], schema=_EDGES)

    return run


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) for every row; node is the hash of its set, null if that is empty."""
    with_workers(docs.sparkSession)
    m, docs = collections(percent / 100), docs.select("doc_id", "text")
    signed = materialise(docs.mapInArrow(_signer(["doc_id"], width, m), "doc_id long, n_shingles long, node long, subs array<bigint>, sketch binary"))
    classes = materialise(
        signed.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("subs").alias("subs"), F.first("sketch").alias("sketch")
        )
    )
    # sub-hashes that several classes share
    subs = classes.select("node", F.posexplode("subs").alias("pos", "sub"))
    shared = subs.groupBy("pos", "sub").agg(F.count("*").alias("_n")).where("_n > 1").select("pos", "sub")
    per_node = subs.join(shared, ["pos", "sub"]).groupBy("node").agg(F.collect_list(F.struct("pos", "sub")).alias("hits"))  # at most 2m each
    tables = materialise(
        per_node.withColumn("a", F.explode(F.filter("hits", lambda x: x["pos"] < m)))
        .withColumn("b", F.explode(F.filter("hits", lambda x: x["pos"] >= m)))
        .select("node", F.xxhash64("a.pos", "a.sub", "b.pos", "b.sub").alias("key"), (F.col("a.pos") == F.col("b.pos") - m).alias("first"))
    )
    # of buckets with the same members one is compared
    members = tables.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_all"), F.min("node").alias("_low"), F.first("first").alias("first")).where("_n > 1")
    buckets = materialise(members.groupBy("_n", "_all", "_low").agg(F.min("key").alias("key"), F.bool_or("first").alias("first")).select("key", "_n", "first"))
    screen = _screener(*reach(percent / 100, 2 * m * ROWS))

    def ties_of(rows: DataFrame) -> DataFrame:  # (key, _n, node, top)
        sketches = deal_blocks(rows.join(classes.select("node", "sketch"), "node"), "key", "node", F.col("_n") / SCREEN)
        return materialise(sketches.select("key", "_i", "_j", "node", "sketch", "top").mapInArrow(screen, "a long, b long"))

    rows = tables.select("key", "node").join(buckets, "key")
    begun = ties_of(rows.where("first").select("key", "_n", "node", F.col("node").alias("top")))
    tops = components(begun)
    rows = rows.where("not first").join(tops.withColumnRenamed("id", "node"), "node", "left").select("key", "_n", "node", F.coalesce("component", "node").alias("top"))
    rows = materialise(rows)
    mixed = rows.groupBy("key").agg(F.min("top").alias("_least"), F.max("top").alias("_most")).where("_least < _most").select("key")
    ties = ties_of(rows.join(mixed, "key", "left_semi"))
    forget(tops, rows)
    tops = components(begun.unionByName(ties))
    clusters = materialise(tops.withColumnRenamed("id", "node").withColumnRenamed("component", "cluster"))
    forget(tables, buckets, begun, ties, tops)
    # exact comparison within clusters
    members = clusters.join(classes.select("node", "least", "n"), "node")
    sizes = members.groupBy("cluster").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("_parts_"))
    members = materialise(members.join(sizes, "cluster").select("node", "cluster", F.ceil("_parts_").cast("int").alias("_parts_"), F.col("least").alias("doc_id")))
    texts = docs.join(_few(members.where("doc_id is not null")), "doc_id").select("node", "cluster", "_parts_", "text")
    if not members.where("doc_id is null").isEmpty():  # classes of rows without an id are found by their sets
        nameless = docs.where("doc_id is null").mapInArrow(_signer(["text"], width, 0), "text string, n_shingles long, node long")
        nameless = nameless.join(members.where("doc_id is null").drop("doc_id"), "node").groupBy("node", "cluster", "_parts_").agg(F.first("text").alias("text"))
        texts = texts.unionByName(nameless)
    sets = texts.mapInArrow(_setter(width), "node long, cluster long, _parts_ int, set array<bigint>")
    links = materialise(deal_blocks(sets, "cluster", "node", F.col("_parts_")).mapInArrow(_comparer(percent), "a long, b long"))
    tops = components(links)
    placed = classes.select("node", "least").join(tops.withColumnRenamed("id", "node"), "node").select("node", "least", "component")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = placed.join(least, "component").select("node", "component_id")
    per_class = materialise(classes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
    forget(links, tops, classes, clusters, members)
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(per_class, "node", "left")
    return out.select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return _placed(docs, width, percent).select("doc_id", "n_shingles", "component_id", kept)


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Rows without words stay, as do those whose id is null (they can't be named as copies of anything). Where the smallest id is
    repeated in its group, the row with the smallest set hash stays, of equal texts the one with the smallest hash of all columns.
    """
    placed = _placed(docs, width, percent)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        dropped = materialise(placed.where("doc_id is not null and doc_id <> component_id").select("doc_id"))
        return docs.join(_few(dropped), "doc_id", "left_anti").select(*docs.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signer(["row", "doc_id"], width, 0), schema)
    copies = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    chosen = placed.where("node is not null and doc_id = component_id").groupBy("doc_id").agg(F.min("node").alias("node"))
    first = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy(F.xxhash64("row")))
    one = keyed.where(copies).join(chosen, ["doc_id", "node"], "left_semi").withColumn("_first", first).where("_first = 1")
    return one.select("row").unionByName(keyed.where(~copies).select("row")).select("row.*")


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
