"""Comparing the members of groups of any size in blocks, without emitting their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_blocks(rows: DataFrame, group: str, member: str, parts: Column) -> DataFrame:
    """Splits every group into ``parts`` blocks and deals its members to all pairs of blocks.

    Adds ``_b`` (the member's block) and ``_i <= _j`` (the pair of blocks that a task compares). Rows are dealt by
    (group, _i, _j) and sorted, so that a task meets one pair of blocks after another; a pair of blocks holds two blocks
    at most, however large its group is.
    """
    rows = rows.withColumn("_parts", F.greatest(F.lit(1), F.ceil(parts).cast("int")))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(77), member), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_other")).withColumn("_j", F.greatest("_b", "_other")).drop("_other", "_parts")
    return rows.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` (integers) of a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest vertex that the edges i-j connect it with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new
