"""Alert states over a stream of requests: a condition on every closed window, held for some time before it fires.

Requests are rolled up by window and route first, so a busy route is combined before it is shuffled, and what reaches the alert's state is one
row a window. A window whose latency quantile is above the limit makes its route ``pending``; once the condition has held from the end
of its first such window for the holding time it is ``firing``; the first window without it is ``resolved`` after firing and ``ok`` otherwise.
A route without requests has no condition: a timer on the end of the silent window ends what was pending or firing, with 0 requests.

Rows that come after their window was closed are in no window. ``late_rows`` counts them apart, from the log and the written states.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.monitoring import BUCKETS
from .access import access_rollup

STATES = "route string, window_start timestamp, requests long, quantile double, state string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = Row("route", "window_start", "requests", "quantile", "state")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def bucket_quantile(q: float = 0.95) -> Column:
    """The quantile of a roll-up's row by interpolation in its cumulative buckets, as ``latency_quantile``."""
    rank = q * F.col("requests")
    bounds, counts = (0.0, *BUCKETS), (F.lit(0), *(F.col(f"le_{k}") for k in range(len(BUCKETS))))
    inside = [F.when(counts[k] >= rank, bounds[k - 1] + (bounds[k] - bounds[k - 1]) * (rank - counts[k - 1]) / (counts[k] - counts[k - 1])) for k in range(1, len(bounds))]
    return F.when(F.col("requests") > 0, F.coalesce(*inside, F.lit(bounds[-1])))


class HeldAlert(StatefulProcessor):
    """The state of a route's alert: the last window's end, and since when its condition holds (0: it does not). Times are microseconds."""

    def __init__(self, window: int, hold: int):
        self.window, self.hold = window, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "ends long, since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ends, since = self.alert.get() if self.alert.exists() else (0, 0)
        if since:
            self.handle.deleteTimer(self._silent(ends))
        for row in sorted(rows, key=lambda r: r["starts"]):  # the windows that closed in this batch
            if since and row["starts"] > ends:
                yield self._ended(key[0], ends, since)
                since = 0
            held, ends = since, row["starts"] + self.window
            since = (since or ends) if row["holds"] else 0
            yield _STATE(key[0], row["window_start"], row["requests"], row["quantile"], self._state(held, since, ends))
        self.alert.update((ends, since))
        if since:
            self.handle.registerTimer(self._silent(ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ends, since = self.alert.get()
        if since:
            self.alert.update((ends, 0))
            yield self._ended(key[0], ends, since)

    def close(self) -> None:
        pass

    def _silent(self, ends: int) -> int:
        """A timer that expires once the watermark reaches the end of the window after ``ends``."""
        return (ends + self.window) // 1000 - 1

    def _state(self, held: int, since: int, ends: int) -> str:
        if since:
            return "firing" if ends - since >= self.hold else "pending"
        return "resolved" if held and ends - self.window - held >= self.hold else "ok"

    def _ended(self, route: str, ends: int, since: int) -> Row:
        """The row of the silent window after ``ends``."""
        return _STATE(route, _EPOCH + timedelta(microseconds=ends), 0, None, self._state(since, 0, ends + self.window))


def alert_states(log: DataFrame, window: timedelta = timedelta(minutes=5), late: timedelta = timedelta(minutes=10), hold: timedelta = timedelta(minutes=15), q: float = 0.95, limit: float = 0.5) -> DataFrame:
    """(route, window_start, requests, quantile, state) of a stream ``log`` (ts, method, route, status, duration): one row for each closed
    window of a route, and for each silent window that ends an alert. A null route is a route of its own, named by an empty string."""
    span = lambda t: int(t / timedelta(microseconds=1))
    if not log.isStreaming:
        raise ValueError("alert states follow a stream; ``alerts`` reads tables")
    named = log.withColumns({"route": F.coalesce("route", F.lit("")), "method": F.lit("")})  # all methods of a route together
    rolled = access_rollup(named, f"{span(window)} microseconds", f"{span(late)} microseconds").withColumn("quantile", bucket_quantile(q))
    starts = F.col("window_start").cast("timestamp")
    rows = rolled.select("route", starts.alias("window_start"), F.unix_micros(starts).alias("starts"), "requests", "quantile", (F.col("quantile") > limit).alias("holds"))
    return rows.groupBy("route").transformWithState(HeldAlert(span(window), span(hold)), STATES, "Append", "EventTime")


def stream_alerts(log: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes the alert states of a stream to Parquet files in ``path``, each row once."""
    conf = log.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # needed by timers
    try:
        return alert_states(log, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def late_rows(log: DataFrame, states: DataFrame, watermark: datetime | str, window: timedelta = timedelta(minutes=5)) -> DataFrame:
    """(route, window_start, late): rows of ``log`` (a table of what was streamed) that came after their window was closed, where there are
    any; ``watermark`` is that of the stream when ``states`` were written."""
    span = F.window(F.col("ts").cast("timestamp"), f"{int(window / timedelta(microseconds=1))} microseconds")
    sent = log.groupBy(F.coalesce("route", F.lit("")).alias("route"), span.alias("w")).agg(F.count("*").alias("sent"))
    sent = sent.where(F.col("w.end") <= F.lit(str(watermark)).cast("timestamp")).select("route", F.col("w.start").alias("window_start"), "sent")
    seen = states.groupBy("route", "window_start").agg(F.sum("requests").alias("seen"))
    return sent.join(seen, ["route", "window_start"], "left").select("route", "window_start", (F.col("sent") - F.coalesce("seen", F.lit(0))).alias("late")).where("late > 0")
