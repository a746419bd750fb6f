"""Sharding by a Feistel permutation with cycle walking over global row numbers (law ``rows``).

Every document gets a global row number from 0 to n - 1 that depends on the rows alone: documents fall into a fixed
number of buckets by a hash of their id and text (so rows with a null or repeated id are spread by their texts), buckets follow
each other, and within a bucket rows are ordered by id (then checksum and size of the text). A keyed Feistel network permutes the numbers below a*b >= n, with a = ceil(sqrt(n))
and b = ceil(n/a); a number that leaves 0..n-1 is permuted again until it is back. The permuted number is the place in
the shuffled corpus: shard = place mod shards, slot = place div shards, so counts differ by at most one and slots have
no gaps. Anyone who knows n, the key and the row number can compute both, and invert them.

Only DataFrame functions are used. One shuffle carries the rows to their bucket; the offsets of buckets are a table of
at most ``BUCKETS`` rows and are broadcast. Defined results: a null text has size 1 and checksum 0; a null doc_id is
ordered first; repeated rows are distinct rows with their own slots, and which of equal rows gets which slot does not
matter; an empty table gives an empty result; further columns pass through ``shard_documents``, whatever their names (a column
of the input that is named like a result column is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, table

BUCKETS = 1 << 14
ROUNDS = 6


def _permute(value: Column, a: int, b: int, seed: int) -> Column:
    """The Feistel network on 0..a*b-1: rounds change the two halves in turn."""
    def step(s: Column, j: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.struct(
            F.when(j % 2 == 0, F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), j, right), F.lit(a)), F.lit(a)))
            .otherwise(left).alias("l"),
            F.when(j % 2 == 1, F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), j, left), F.lit(b)), F.lit(b)))
            .otherwise(right).alias("r"),
        )

    a_, b_ = F.lit(a).cast("long"), F.lit(b).cast("long")
    start = F.struct(F.pmod(value, a_).alias("l"), F.pmod(F.floor(value / a_).cast("long"), b_).alias("r"))
    return F.aggregate(
        F.array(*(F.lit(j) for j in range(ROUNDS))),
        start,
        lambda s, j: F.struct(step(s, j)["l"].cast("long").alias("l"), step(s, j)["r"].cast("long").alias("r")),
        lambda s: s["l"] + a_ * s["r"],
    )


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """How often a number must be permuted again at most, found from the fewer than sqrt(n) numbers outside 0..n-1."""
    a, b = domain(n)
    out, left, steps = spark.range(n, a * b).select(F.col("id").alias("v")), a * b - n, 0
    while left:
        out = out.select(_permute(F.col("v"), a, b, seed).alias("v")).where(F.col("v") >= n)
        still = out.count()
        if still == left:  # the rest are cycles wholly outside, which no number of 0..n-1 meets
            break
        left, steps = still, steps + 1
    return steps


def place(number: Column, n: int, steps: int, seed: int) -> Column:
    """The place of a row number in the shuffled corpus of ``n`` rows."""
    a, b = domain(n)
    first = _permute(number, a, b, seed)
    if not steps:
        return first
    return F.aggregate(
        F.array(*(F.lit(k) for k in range(steps))), first,
        lambda v, _: F.when(v < n, v).otherwise(_permute(v, a, b, seed)).cast("long"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240607, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    bucket, start, inside, at = free_names(docs.columns, "_bucket", "_start", "_inside", "_place")
    hashed = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)).cast("int").alias(bucket)
    counts = docs.select(hashed).groupBy(bucket).agg(F.count("*")).collect()  # at most ``buckets``
    n, offsets = 0, []
    for k, rows in sorted(counts):
        offsets.append((k, n))
        n += rows
    steps = walk_length(spark, n, seed)
    starts = spark.createDataFrame(offsets or [(0, 0)], f"{bucket} int, {start} long")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in own), hashed, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    order = Window.partitionBy(bucket).orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    rows = rows.withColumn(inside, F.row_number().over(order) - 1).join(F.broadcast(starts), bucket)
    rows = rows.withColumn(at, place(F.col(start) + F.col(inside), n, steps, seed))
    return rows.select(
        *(F.col(f"`{c}`") for c in own), "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col(at), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col(at) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).drop("text")
