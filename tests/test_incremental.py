import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import incremental as inc
from tessera.operators import merge as mg
from tessera.operators.monitoring import alerts, dataset_status, latency_histogram, latency_quantile
from tessera.operators.scans import RANGE, in_ranges, running
from tessera.schema import FAILURES, ITEMS

T0 = "2030-02-03 00:00:00"
LIST = "page int, pos int, item_id long, url string, title string, creator_name string, thumbnail_url string, view_count long, favorite_count long"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page long, has_new boolean, failed boolean, last_page long")


def _cut(spark, rows, **kw):
    return tuple(inc.scan_cutoff(_pages(spark, rows), **kw).first())


def test_scan_cutoff(spark):
    new = lambda p: (p, True, False, 20)
    old = lambda p: (p, False, False, 20)
    bad = lambda p: (p, False, True, None)
    assert _cut(spark, [new(1), old(2), old(3), old(4), old(5)]) == (4, "stable")
    assert _cut(spark, [old(1), bad(2), old(3), new(4), old(5), old(6)], stable=2) == (3, "stable")
    assert _cut(spark, [new(1), bad(2), bad(3), bad(4), bad(5)]) == (4, "failures")
    assert _cut(spark, [new(1), bad(2), bad(3), old(4), bad(5), new(6)]) == (6, "end")
    assert _cut(spark, [(1, True, False, 2), (2, True, False, 2), (3, True, False, 2)]) == (2, "last_page")
    assert _cut(spark, [new(p) for p in range(1, 9)], max_pages=3) == (3, "max_pages")


def test_checkpoint_and_resume(spark):
    pages = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False), (5, False)], "page long, failed boolean")
    assert inc.contiguous_checkpoint(pages).first().checkpoint == 2
    listed = spark.createDataFrame([(p, 10 * p + k) for p in range(1, 11) for k in range(3)], "page long, item_id long")
    seen = lambda upto: spark.createDataFrame([(10 * p + k, dt.datetime(2030, 2, 4) if p <= upto else dt.datetime(2029, 1, 1)) for p in range(1, 11) for k in range(3)], "item_id long, list_seen_at timestamp_ntz")
    go = lambda upto, **kw: inc.resume_page(listed, seen(upto), T0, **kw).first().page
    assert go(4, checkpoint=4, target=10) == 4 and go(2, checkpoint=4, target=10) == 2 and go(9, checkpoint=4, target=10) == 4
    assert go(9, checkpoint=10, target=10) == 1 and go(9, checkpoint=0, target=10) == 1


def test_scans_split_into_ranges(spark):
    """Random scans, cut into ranges at random, against a loop over the pages; no window without partitions is in the plan."""
    rnd = random.Random(12)
    for ranges in (1, 2, 5, 40):
        n = rnd.randint(1, 60)
        rows = [(p, rnd.random() < 0.3, rnd.random() < 0.4, rnd.choice((n + 5, n, max(1, n - 3)))) for p in range(1, n + 1)]
        stable = fails = last = 0
        want = (n, "end")
        for page, has_new, failed, known in rows:
            fails = fails + 1 if failed else 0
            if not failed:
                stable, last = 0 if has_new else stable + 1, known
            why = "stable" if not failed and stable >= 3 else "failures" if failed and fails >= 3 else "last_page" if last and page >= last else None
            if why:
                want = (page, why)
                break
        pages = _pages(spark, rows).repartition(3)
        cut = inc.scan_cutoff(pages, ranges=ranges)
        assert tuple(cut.first()) == want
        assert inc.contiguous_checkpoint(pages).first().checkpoint == next((p - 1 for p, _, failed, _ in rows if failed), n)
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert ranges == 1 or len(windows) >= 2 and all(f"windowspecdefinition({RANGE}#" in line and f"[{RANGE}#" in line for line in windows)
        assert "Window [" not in inc.contiguous_checkpoint(pages)._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_and_maxima(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, rnd.randint(-5, 5)]), rnd.choice([None, rnd.randint(0, 99)])) for k in rnd.sample(range(10**6), 300)]
    df = in_ranges(spark.createDataFrame(rows, "k long, a int, b int").repartition(4), "k", 17)
    got = sorted((r.k, r.total, r.top) for r in running(df, "k", {"total": F.col("a")}, {"top": F.col("b")}).collect())
    total, top, want = 0, None, []
    for k, a, b in sorted(rows, key=lambda r: r[0]):
        total += a or 0
        top = b if top is None else max(top, b if b is not None else top)
        want.append((k, total, top))
    assert got == want
    assert df.select("_range").distinct().count() == 17
    assert running(in_ranges(spark.createDataFrame([], "k long, a int"), "k"), "k", {"total": F.col("a")}).count() == 0


def test_failure_ledger(spark):
    """Attempts add up, waits double up to a week, the newest failure's words stay, and what is done leaves."""
    key = "entity_type string, entity_id string, operation string, url string, error_type string, error_message string, seq int"
    rows = [("item", str(e), "detail", f"u{e}-{k}", "Refused", "x" * 2500, k) for e in (41, 58) for k in range(5 if e == 41 else 11)] + [("page", "3", "list", "p", "Refused", "", 1), ("item", "a7", "detail", "p", "Refused", "", 1)]
    batch = spark.createDataFrame(rows, key)
    at = dt.datetime.fromisoformat(T0)
    ledger = inc.merge_failures(spark.createDataFrame([], FAILURES), batch, T0)
    got = {(r.entity_type, r.entity_id): r for r in ledger.collect()}
    assert {k: r.attempts for k, r in got.items()} == {("item", "41"): 5, ("item", "58"): 11, ("page", "3"): 1, ("item", "a7"): 1}
    for r in got.values():
        assert r.next_retry_at - at == min(dt.timedelta(minutes=30) * 2 ** (r.attempts - 1), dt.timedelta(days=7)) and r.last_failed_at == at
    assert got["item", "41"].url == "u41-4" and len(got["item", "41"].error_message) == 2000
    due = lambda hours, cap: [r.item_id for r in inc.retry_due(ledger, str(at + dt.timedelta(hours=hours)), cap=cap).collect()]
    assert due(7.9, 20) == [] and due(8, 20) == [41] and due(8, 5) == [] and due(200, 20) == [41, 58]
    assert {r.entity_id for r in inc.clear_failures(ledger, batch.where("entity_id = '41'")).collect()} == {"58", "3", "a7"}
    again = inc.merge_failures(ledger, batch.where("entity_id = '41' and seq = 0"), str(at + dt.timedelta(days=1)))
    assert {r.entity_id: r.attempts for r in again.collect()} == {"41": 6, "58": 11, "3": 1, "a7": 1}


def _items(spark, rows):
    base = dict.fromkeys([f.split()[0] for f in ITEMS.split(", ")])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], ITEMS)


def test_listing_merge(spark):
    items = _items(spark, [
        dict(item_id=1, title="a", creator_display_name="x", thumbnail_url="t", view_count=1, favorite_count=1, status="active", detail_fetched_at=dt.datetime(2030, 1, 9)),
        dict(item_id=2, title="b", status="missing", detail_fetched_at=dt.datetime(2030, 1, 9)), dict(item_id=3, title="c", status="active"),
    ])
    batch = spark.createDataFrame([(1, 0, 1, "u", "old", "x", None, 1, 1), (2, 0, 1, "u1", "a", "x", None, 1, 1), (1, 1, 2, "u2", "b", None, None, None, None), (1, 2, 9, "u9", "n", "y", "t9", None, 3)], LIST)
    flags = {r.item_id: (r.is_new, r.list_changed, r.needs_detail) for r in mg.classify_listing(items, batch).collect()}
    assert flags == {1: (False, True, False), 2: (False, True, True), 9: (True, True, True)}  # a null over a stored thumbnail is a change
    out = {r.item_id: r for r in mg.merge_listing(items, batch, T0).collect()}
    assert (out[1].title, out[1].thumbnail_url, out[2].status, out[9].status, out[3].title) == ("a", "t", "missing", "active", "c")
    assert out[9].created_at == dt.datetime.fromisoformat(T0) and out[3].updated_at is None


def test_detail_and_missing_merge(spark):
    items = _items(spark, [dict(item_id=1, title="a", comment="keep?", thumbnail_url="t", status="missing", view_count=5), dict(item_id=2, title="b", status="active", view_count=7)])
    ref = "struct<id:bigint,name:string,url:string>"
    detail = spark.createDataFrame(
        [(1, "u", None, "A", (4, "C", None), [(5, "five", None), (5, "five", None)], [], [(6, "six", "s")], None, None, None, 3, None)],
        f"item_id long, url string, video_url string, title string, creator {ref}, tags array<{ref}>, origins array<{ref}>, characters array<{ref}>, thumbnail_url string, published_at timestamp_ntz, view_count long, favorite_count long, comment string",
    )
    row = mg.merge_detail(items, detail, T0).where("item_id = 1").first()
    assert (row.status, row.title, row.comment, row.thumbnail_url, row.view_count, row.creator_id) == ("active", "A", None, "t", None, 4)
    gone = mg.merge_missing(items, spark.createDataFrame([(2, "g2"), (3, "g3")], "item_id long, url string"), T0)
    out = {r.item_id: (r.title, r.status, r.view_count) for r in gone.collect()}
    assert out == {1: ("a", "missing", 5), 2: ("b", "missing", 7), 3: ("", "missing", None)}
    refs = mg.entity_refs(detail)
    entities = mg.merge_entities(spark.createDataFrame([("tags", 5, "old", "url")], "kind string, entity_id long, name string, url string"), refs, T0)
    assert {(r.kind, r.entity_id): (r.name, r.url) for r in entities.collect()} == {("tags", 5): ("five", "url"), ("characters", 6): ("six", "s"), ("authors", 4): ("C", None)}
    links = spark.createDataFrame([(1, "tags", 9), (2, "tags", 9)], "item_id long, kind string, entity_id long")
    assert sorted(map(tuple, mg.replace_links(links, detail, refs).collect())) == [(1, "authors", 4), (1, "characters", 6), (1, "tags", 5), (2, "tags", 9)]


def test_refresh_selection_and_gate(spark):
    now = dt.datetime(2031, 3, 20, 9)
    ago = lambda days: None if days is None else now - dt.timedelta(days=days)
    cases = {k: x for k, x in enumerate((("active", 20, 4), ("active", 20, 2), ("active", 45, 40), ("missing", 20, 4), ("active", 29, 9), ("active", 20, None), ("active", None, None)), 1)}
    items = _items(spark, [dict(item_id=k, status=s, published_at=ago(p), detail_fetched_at=ago(d)) for k, (s, p, d) in cases.items()])
    assert [r.item_id for r in inc.stale_details(items, str(now)).collect()] == [5, 1]
    assert [r.item_id for r in inc.missing_details(items).collect()] == [7, 6]
    items = items.where("item_id < 4").withColumn("detail_fetched_at", F.when(F.col("item_id") < 3, F.col("detail_fetched_at")))
    queue = inc.work_queue({"missing": inc.missing_details(items), "stale": items.select("item_id")}, spark.createDataFrame([(2,)], "item_id long"))
    assert sorted(map(tuple, queue.collect())) == [(1, "stale"), (3, "missing")]
    pages = lambda *n: spark.createDataFrame([(p, len(n), k) for p, k in enumerate(n, 1)], "page int, last_page int, n_items int")
    details = lambda k: spark.createDataFrame([("drift",)] * k + [("ok",)], "outcome string")
    assert inc.quality_gate(pages(3, 3, 0), details(4)).first().stop is False
    assert inc.quality_gate(pages(3, 0, 3), details(0)).first().stop and inc.quality_gate(pages(3), details(5)).first().stop


def test_runs_and_alerts(spark):
    events = spark.createDataFrame([(1, "new_items"), (1, "pages_checked"), (2, "failed_pages"), (3, "drift_errors")], "run_id long, event string")
    summary = inc.run_summary(events)
    assert {r.run_id: r.status for r in summary.collect()} == {1: "success", 2: "partial", 3: "failed"}
    assert [r.c for r in summary.select("run_id", inc.needs_full_refresh(summary).alias("c")).orderBy("run_id").collect()] == [True, False, False]
    runs = spark.createDataFrame([(k, "running", dt.datetime(2030, 1, 9), None, None) for k in (1, 4, 5)], "run_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error string")
    closed = inc.close_runs(runs, summary, T0)
    assert {r.run_id: (r.status, r.error) for r in closed.collect()} == {1: ("success", None), 4: ("failed", "abandoned"), 5: ("running", None)}
    log = spark.createDataFrame([("GET", "/", 0.02)] * 10 + [("GET", "/", 2.0)] * 10, "method string, route string, duration double")
    q = latency_quantile(latency_histogram(log), 0.5)
    assert abs(q.first().quantile - 0.025) < 1e-9
    slow = latency_quantile(latency_histogram(log), 0.95)
    status = dataset_status(spark.createDataFrame([("active",)], "status string"), closed)
    fired = {r.alert: r.firing for r in alerts(status, slow, spark.createDataFrame([(11,)], "throttled int"), "2030-02-03 00:10:00").collect()}
    assert fired == {"stale": False, "last_run_failed": False, "throttled": True, "slow_pages": True}


def test_numbered_with_null_and_far_keys(spark):
    keys = [None, None, -(2**62), 2**62, *range(0, 3000, 3)]
    rows = mg.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k", 16)
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r.k for r in rows.orderBy("_number").collect()] == order and sorted(r._number for r in rows.collect()) == list(range(1, len(keys) + 1))
    bins = [r.n for r in rows.groupBy(F.floor(F.col("_number") / 100)).agg(F.count("*").alias("n")).collect()]
    assert max(bins) <= 100


def test_export_and_backfills(spark, tmp_path):
    items = _items(spark, [dict(item_id=i * 7, status="active" if i % 3 else "missing", updated_at=dt.datetime(2030, 1, 9)) for i in range(100)])
    chunks = mg.export_chunks(items, 10)
    rows = sorted((r.chunk, r.pos, r.item_id) for r in chunks.collect())
    assert [r[2] for r in rows] == [i * 7 for i in range(100) if i % 3] and [r[:2] for r in rows] == [(k // 10, k % 10) for k in range(66)]
    assert {r.chunk: r.n for r in mg.chunk_index(chunks).collect()}[6] == 6
    urls = spark.createDataFrame([("https://a.example.com/x",), ("http://example.com",), (None,)], "url string")
    assert sorted((r.url or "", r.changed) for r in mg.backfill_urls(urls, {"url": ("example.com",)}).collect()) == [("", False), ("", True), ("https://a.example.com/x", False)]
    path = str(tmp_path / "t")
    mg.publish(urls, path, 1)
    mg.publish(urls.limit(1), path, 2)
    assert mg.current(spark, path).count() == 1 and mg.current_version(spark, path) == 2
    mg.publish(urls, path, 2)  # a complete version stays as it is
    (tmp_path / "t/v=3").mkdir()  # a write that has not been committed
    assert mg.current(spark, path).count() == 1
