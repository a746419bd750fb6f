"""Alert states over streams, against a plain Python model of the state machine."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators.monitoring import BUCKETS, latency_histogram, latency_quantile
from tessera.streaming.access import access_rollup
from tessera.streaming.alerts import alert_states, bucket_quantile, late_rows, stream_alerts

LOG = "ts timestamp, method string, route string, status int, duration double"
T0 = dt.datetime(2032, 4, 1)
WIN, LATE, HOLD = dt.timedelta(minutes=5), dt.timedelta(minutes=10), dt.timedelta(minutes=15)


def _quantile(durations):
    rank, low, before = 0.95 * len(durations), 0.0, 0
    for b in BUCKETS:
        n = sum(d <= b for d in durations)
        if n >= rank:
            return low + (b - low) * (rank - before) / (n - before)
        low, before = b, n
    return BUCKETS[-1]


def _model(rows, watermark):
    """{(route, window): (requests, state)} of closed windows, and silent ones that end an alert."""
    windows = {}
    for ts, _, route, _, duration in rows:
        windows.setdefault((route or "", T0 + (ts - T0) // WIN * WIN), []).append(duration)
    out = {}
    for route in {r for r, _ in windows}:
        mine = {w: d for (r, w), d in windows.items() if r == route}
        w, since, state = min(mine), None, "ok"
        while w + WIN <= watermark:
            held = w in mine and _quantile(mine[w]) > 0.5
            if held:
                since = since or w + WIN
                state = "firing" if w + WIN - since >= HOLD else "pending"
            elif w in mine or since:
                state, since = "resolved" if state == "firing" else "ok", None
            if w in mine or (state == "resolved" and (route, w - WIN) in out and out[route, w - WIN][1] == "firing") or ((route, w - WIN) in out and out[route, w - WIN][1] == "pending"):
                out[route, w] = len(mine.get(w, [])), state
            w += WIN
    return out


def _log(rnd, windows=60):
    rows = []
    for route in ("search", "item", None):
        bad = False
        for k in range(windows):
            bad = rnd.random() < (0.8 if bad else 0.3)
            if rnd.random() < 0.85:  # else silent
                for _ in range(rnd.randint(1, 4)):
                    at = T0 + k * WIN + dt.timedelta(seconds=rnd.randrange(300))
                    rows.append((at, rnd.choice(("GET", "POST")), route, 200, rnd.choice((0.7, 3.0, 9.0)) if bad else rnd.random() / 3))
    return sorted(rows, key=lambda r: r[0])


def _read(spark, path):
    got = spark.read.parquet(path)
    rows = [((r.route, r.window_start), (r.requests, r.state)) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return got, dict(rows)


def _feed(spark, rows, folder, steps):
    for k in range(steps):
        part = rows[len(rows) * k // steps : len(rows) * (k + 1) // steps]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_states_do_not_depend_on_micro_batches(spark, tmp_path):
    rows = _log(random.Random(3))
    want = _model(rows, rows[-1][0] - LATE)
    assert {s for _, s in want.values()} == {"ok", "pending", "firing", "resolved"} and any(n == 0 for n, _ in want.values())
    for steps in (1, 5):
        folder = f"{tmp_path}/in{steps}"
        stream_alerts(_feed(spark, rows, folder, steps), f"{tmp_path}/out{steps}", f"{tmp_path}/cp{steps}").awaitTermination()
        states, got = _read(spark, f"{tmp_path}/out{steps}")
        assert got == want
        assert late_rows(spark.read.schema(LOG).parquet(folder), states, rows[-1][0] - LATE).count() == 0


def test_a_restart_goes_on_and_late_rows_are_counted_apart(spark, tmp_path):
    rows = _log(random.Random(6), 40)
    cut = len(rows) // 2
    late = [(T0 + dt.timedelta(seconds=7 * k), "GET", "search", 200, 9.0) for k in range(5)]
    folder, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    stream_alerts(_feed(spark, rows[:cut], folder, 2), out, cp).awaitTermination()
    stream_alerts(_feed(spark, rows[cut:] + late, folder, 1), out, cp).awaitTermination()
    states, got = _read(spark, out)
    assert got == _model(rows, rows[-1][0] - LATE)
    found = late_rows(spark.read.schema(LOG).parquet(folder), states, rows[-1][0] - LATE).collect()
    assert [(r.route, r.window_start, r.late) for r in found] == [("search", T0, 5)]


def test_quantile_of_a_rollup_equals_that_of_histograms(spark):
    log = spark.createDataFrame(_log(random.Random(9), 6), LOG).withColumn("method", F.lit("")).fillna("", ["route"])
    rolled = access_rollup(log, "1 day").select("route", bucket_quantile().alias("q"))
    want = {r.route: r.quantile for r in latency_quantile(latency_histogram(log, ("route",)), 0.95, ("route",)).collect()}
    assert {r.route: r.q for r in rolled.collect()} == want


def test_tables_are_refused(spark):
    try:
        alert_states(spark.createDataFrame([], LOG))
    except ValueError:
        return
    raise AssertionError("a table was taken")
