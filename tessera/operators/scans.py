"""Running sums and maxima over an ordered table of any size, without sorting it in one task.

Rows are split into ranges of the key; each range is scanned by itself, and what its predecessors carry into it is combined from a
table of a row a range, whose number is bounded. Sums and maxima are associative, so the result is that of one scan over all rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
RANGE = "_range"


def in_ranges(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """Adds the number of the row's range of ``key``, a number without nulls; ranges follow approximate quantiles."""
    cuts = df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(RANGE, F.lit(0))
    at = df.withColumn("_at", F.col(key).cast("double"))
    return Bucketizer(splits=splits, inputCol="_at", outputCol=RANGE).transform(at).drop("_at").withColumn(RANGE, F.col(RANGE).cast("int"))


def running(df: DataFrame, key: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima (nulls do not count) up to and with each row of ``in_ranges``, in the order of ``key``."""
    sums, maxima = sums or {}, maxima or {}
    df = df.withColumns({**sums, **maxima})
    totals = df.groupBy(RANGE).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))
    every = totals.agg(F.collect_list(F.struct(F.col(RANGE).alias("at"), *sums, *maxima)).alias("_every"))  # one row of a struct a range
    before = F.filter("_every", lambda x: x["at"] < F.col(RANGE))
    of = lambda c: F.transform(before, lambda x: x[c])
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    carry = totals.join(F.broadcast(every)).select(
        RANGE, *(total(of(c)).alias(f"_before_{c}") for c in sums), *(F.array_max(of(c)).alias(f"_before_{c}") for c in maxima)
    )
    here = Window.partitionBy(RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(F.broadcast(carry), RANGE)
    out = out.withColumns({c: F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(f"_before_{c}") for c in sums} | {c: F.greatest(F.max(c).over(here), F.col(f"_before_{c}")) for c in maxima})
    return out.drop(*(f"_before_{c}" for c in (*sums, *maxima)))
