"""Embedding near-dedup with randomised-rotation binary codes.

Every distinct vector is rotated at random; the signs are its binary code, and the inner product of code and rotated
vector is stored as correction factor f. <code_x, rotated y> / f_x is an unbiased estimate of the cosine of x and y, and
its error stays below ``EPS`` * sqrt((1 - f^2) / f^2) / sqrt(D - 1) but with a tiny probability. The rotated vector itself is carried
in whole numbers of one byte, with the length of what rounding took away, which widens the bound. Pairs whose upper bound
lies below the threshold, seen from either vector, are out; all others are recomputed exactly in double precision.

Candidates: further rotations give more sign bits; a vector has ``tables`` keys of ``bits`` bits, and vectors of one label
that share a key are candidates. Bits grow with the logarithm of the largest label, so that chance meetings stay
rare, and the number of tables follows from the chance that a pair at the threshold shares a key: at most ``MISS`` of such
pairs share none. Buckets with the same members are compared once, from codes alone, in blocks within tasks that return one
tie a vector. Tied vectors form clusters; only to those the vectors are sent, once and in blocks, and each pair of a cluster meets
in one task, which returns counts and one edge a vector, never pairs.

Equal vectors are one class: they are found by two 64-bit hashes and never compared. Defined results: a vector that is
null, empty, zero or holds null or non-finite components, and one whose label or id is null, links with nothing; labels may have
any type; vectors are scaled by their largest component, so very large and very small ones count; vectors of different
lengths are not compared; a repeated id counts as another vector in n_links and shares the component; an empty table gives an
empty result; other columns pass through ``dedup_vectors``, whatever their names (result names are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deal_blocks, groups, lowest
from .common import components, forget, free_names, materialise, mix, table, with_workers

THRESHOLD = 0.98
EPS = 5.0
MISS = 1e-6
BLOCK = 256
SCREEN = 512  # codes in a block
SEED = 42


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim, k])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def layout(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables) for labels of up to ``largest`` vectors."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, largest))) + 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(binary codes, correction factors, rotated vectors in bytes, their scales, lengths of what rounding took) of unit vectors."""
    rotated = x @ rotation(x.shape[1], 0)
    factor = np.abs(rotated).sum(1) / math.sqrt(x.shape[1])
    scale = np.abs(rotated).max(1) / 127
    whole = np.rint(rotated / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((rotated - whole * scale[:, None]) ** 2).sum(1))
    return np.packbits(rotated >= 0, axis=1), factor, whole, scale, lost


def table_keys(x: np.ndarray, label: np.ndarray, bits: int, tables: int) -> np.ndarray:
    n, dim = x.shape
    signs = np.concatenate([x @ rotation(dim, k) >= 0 for k in range(1, 2 + (bits * tables - 1) // dim)], axis=1)
    power = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
    words = (signs[:, : bits * tables].reshape(n, tables, bits) * power).sum(2, dtype=np.uint64)
    salt = mix(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(dim))
    return mix(words ^ mix(label.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :])).view(np.int64)


_CODED = "class_id long, code binary, factor double, whole binary, scale double, lost double, keys array<bigint>"


def _encoder(bits: int, tables: int):
    schema = pa.schema([("class_id", pa.int64()), ("code", pa.binary()), ("factor", pa.float64()), ("whole", pa.binary()), ("scale", pa.float64()), ("lost", pa.float64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(start, 1024)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    rows = batch.filter(pa.array(dims == dim))
                    x = unit(rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    codes, factor, whole, scale, lost = encode(x)
                    keys = table_keys(x, rows.column("label").to_numpy(), bits, tables)
                    yield pa.RecordBatch.from_arrays([
                        rows.column("class_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor),
                        pa.array([v.tobytes() for v in whole], pa.binary()), pa.array(scale), pa.array(lost), pa.array(list(keys), pa.list_(pa.int64())),
                    ], schema=schema)

    return run


def may_reach(codes: np.ndarray, factor: np.ndarray, whole: np.ndarray, scale: np.ndarray, lost: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each two vectors may reach ``threshold``, by the upper bounds of both estimates."""
    dim = whole.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    estimate = (signs @ whole.T.astype(np.float32)) * scale[None, :] / (math.sqrt(dim) * factor[:, None])
    bound = EPS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    maybe = estimate + bound[:, None] + lost[None, :] / factor[:, None] + 1e-5 >= threshold  # single precision sums
    return maybe & maybe.T


_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _screener(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for rows in groups(batches, ("key", "_i", "_j")):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            bytes_of = lambda c, t, n=rows.num_rows: np.frombuffer(b"".join(rows[c].to_pylist()), dtype=t).reshape(n, -1)  # noqa: E731, B023
            maybe = may_reach(bytes_of("code", np.uint8), rows["factor"].to_numpy(), bytes_of("whole", np.int8), rows["scale"].to_numpy(), rows["lost"].to_numpy(), threshold)
            ident = rows["class_id"].to_numpy()
            low = lowest(len(ident), *np.nonzero(maybe))
            some = np.flatnonzero(low != np.arange(len(ident)))
            left.append(ident[some])
            right.append(ident[low[some]])
            if len(left) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_TIES)
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_TIES)

    return run


def _comparer(threshold: float, kind: type):
    schema = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links, lows = [], [], []
        for rows in groups(batches, ("cluster", "_i", "_j")):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            block, i, j = rows["_b"].to_numpy(), rows["_i"][0].as_py(), rows["_j"][0].as_py()
            x = unit(np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=kind).reshape(len(block), -1))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = x[left] @ x[right].T >= threshold
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            a, b = left[a], right[b]
            if not len(a):
                continue
            weight, ident = rows["weight"].to_numpy(), rows["class_id"].to_numpy()
            total = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
            low = lowest(len(x), a, b)
            some = np.flatnonzero(total)
            ids.append(ident[some])
            links.append(total[some].astype(np.int64))
            lows.append(ident[low[some]])
            if len(ids) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, links, lows)], schema=schema)
                ids, links, lows = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, links, lows)], schema=schema)

    return run


def _to_bytes(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([np.asarray(v.values.to_numpy(), kind).tobytes() for v in batch.column("embedding")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "vector"])

    return run


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with n_links, component_id and kept."""
    with_workers(vectors.sparkSession)
    made = ("n_links", "component_id", "kept")
    own = [F.col(f"`{c}`") for c in vectors.columns if c not in made]
    first, second = free_names([*vectors.columns, *made], "_first", "_second")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    e = F.col("embedding").cast("array<float>" if single else "array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    hashed = vectors.select(*own, F.when(able, F.xxhash64(F.lit(1), "label", e)).alias(first), F.when(able, F.xxhash64(F.lit(2), "label", e)).alias(second))
    able_rows = hashed.where(F.col(first).isNotNull()).select(
        F.col(first).alias("class_id"), F.col(second).alias("second"), "vec_id", F.xxhash64("label").alias("label"), e.alias("embedding")
    )
    # the hashes name the class, as an id may be repeated with other components
    classes = materialise(able_rows.groupBy("class_id", "second").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.size(F.first("embedding")).alias("dim"), F.first("embedding").alias("embedding")
    ))
    largest = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    coded = materialise(classes.select("class_id", "label", "dim", "embedding").mapInArrow(_encoder(*layout(largest, threshold, miss)), _CODED))
    keys = coded.select("class_id", F.explode("keys").alias("key"))
    members = keys.groupBy("key").agg(F.count("*").alias("_count"), F.bit_xor(F.xxhash64("class_id")).alias("_all"), F.min("class_id").alias("_low")).where("_count > 1")
    buckets = members.groupBy("_count", "_all", "_low").agg(F.min("key").alias("key")).select("key", "_count")
    codes = keys.join(buckets, "key").join(coded.drop("keys"), "class_id")
    ties = materialise(deal_blocks(codes, "key", "class_id", F.col("_count") / SCREEN).drop("_count", "_b").mapInArrow(_screener(threshold), "a long, b long"))
    clusters = components(ties)
    # vectors are sent to their clusters only
    sizes = clusters.groupBy("component").agg(F.count("*").alias("_count"))
    placed = clusters.join(sizes, "component").select(F.col("id").alias("class_id"), F.col("component").alias("cluster"), "_count")
    kind = np.float32 if single else np.float64
    sent = placed.join(classes.select("class_id", "weight", "embedding"), "class_id").select("class_id", "cluster", "_count", "weight", "embedding")
    sent = sent.mapInArrow(_to_bytes(kind), "class_id long, cluster long, _count long, weight long, vector binary")
    found = materialise(deal_blocks(sent, "cluster", "class_id", F.col("_count") / BLOCK).mapInArrow(_comparer(threshold, kind), "class_id long, links long, low long"))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    tops = components(found.select(F.col("class_id").alias("a"), F.col("low").alias("b")))
    named = (
        classes.select("class_id", "second", "weight", "least")
        .join(counts, "class_id", "left")
        .join(tops.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("class_id", "second", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("top"))
    )
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    per_class = materialise(named.join(least, "top").drop("top", "least"))
    forget(classes, coded, ties, clusters, found, tops)
    component = F.coalesce("component_id", "vec_id")
    per_class = per_class.withColumnsRenamed({"class_id": first, "second": second})
    return hashed.join(per_class, [first, second], "left").select(
        *own, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def op5_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings")).drop("embedding")
