"""Access-log rollups in five-minute windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.monitoring import BUCKETS


def access_rollup(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and cumulative latency buckets by window, method and route; for streams and tables alike."""
    if log.isStreaming:
        log = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a time with zone
    rolled = log.groupBy(F.window("ts", window).alias("w"), "method", "route").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), *(F.count_if(F.col("duration") <= b).alias(f"le_{k}") for k, b in enumerate(BUCKETS))
    )
    return rolled.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "method", "route", "requests", "errors", *(f"le_{k}" for k in range(len(BUCKETS))))
