"""Dataset status, access metrics and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ntz

#: Upper bounds of the latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def dataset_status(items: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: active items, finish of the last good run, and the last run's status and finish."""
    a = items.agg(F.count_if(F.col("status") == "active").alias("active_items"))
    good = F.col("status").isin("success", "partial")
    b = runs.agg(F.max(F.when(good, F.col("finished_at"))).alias("last_good_at"), F.max_by(F.struct("run_id", "status", "finished_at"), "run_id").alias("x"))
    return a.join(F.broadcast(b)).select("active_items", "last_good_at", F.col("x.run_id").alias("last_run_id"), F.col("x.status").alias("last_status"), F.col("x.finished_at").alias("last_finished_at"))


def data_version(runs: DataFrame, refreshed_at) -> DataFrame:
    return runs.agg(F.concat_ws(":", F.coalesce(F.max("run_id"), F.lit(0)).cast("string"), F.date_format(ntz(refreshed_at), "yyyy-MM-dd'T'HH:mm:ss")).alias("version"))


def status_histogram(log: DataFrame) -> DataFrame:
    """(run_id, status_codes): a map of counts by status code, as JSON by ascending code."""
    each = log.groupBy("run_id", "status").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("status", "n")))
    return each.groupBy("run_id").agg(F.to_json(F.map_from_entries(entries)).alias("status_codes"))


def access_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "route", "status").agg(F.count("*").alias("n"))


def latency_histogram(log: DataFrame, keys: tuple[str, ...] = ("method", "route")) -> DataFrame:
    """Cumulative counts by bucket: one pass with a conditional count for every bound, then one row a bound."""
    counts = log.groupBy(*keys).agg(*(F.count_if(F.col("duration") <= b).alias(f"b{k}") for k, b in enumerate(BUCKETS)), F.count("*").alias("total"), F.sum("duration").alias("seconds"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BUCKETS)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return counts.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.le", "x.n")


def latency_quantile(histogram: DataFrame, q: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantile by linear interpolation within the first bucket that reaches it, over the summed histograms of ``keys``.

    Beyond the last finite bound the result is that bound; a group without observations has none.
    """
    total = histogram.groupBy(*keys, "le").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy("le")
    steps = total.select(*keys, "le", "n", F.lag("le", 1, 0.0).over(up).alias("low"), F.lag("n", 1, 0).over(up).alias("before"), F.max("n").over(Window.partitionBy(*keys)).alias("all"))
    rank = q * F.col("all")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("before")) / (F.col("n") - F.col("before"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    found = steps.where((F.col("all") > 0) & (F.col("n") >= rank))
    return found.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def alerts(status: DataFrame, quantiles: DataFrame, throttled: DataFrame, now, interval_seconds: int = 21_600) -> DataFrame:
    """(alert, firing) for stale data, a failed last run, throttling and slow pages.

    ``quantiles`` (window, quantile) are the windows of the holding time: the latency alert needs all of them above the limit.
    """
    age = F.timestamp_diff("SECOND", F.col("last_good_at"), ntz(now))
    slow = quantiles.agg(F.coalesce(F.min("quantile") > 0.5, F.lit(False)).alias("slow"))
    row = status.join(F.broadcast(slow)).join(F.broadcast(throttled.agg(F.coalesce(F.sum("throttled"), F.lit(0)).alias("throttled"))))  # one row each
    rules = {
        "stale": F.coalesce(age > 2 * interval_seconds, F.lit(True)), "last_run_failed": F.coalesce(F.col("last_status") == "failed", F.lit(False)),
        "throttled": F.col("throttled") > 10, "slow_pages": F.col("slow"),
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("alert"), v.alias("firing")) for k, v in rules.items()))).alias("x")).select("x.alert", "x.firing")
