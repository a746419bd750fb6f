"""Commits over several tables: atomic, one writer at a time, parts untouched by a batch stay as they are; streams that break off."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.operators import commits as cm
from tessera.operators import merge as mg
from tessera.schema import FAILURES
from tessera.streaming import apply

from .test_incremental import T0, _items
from .test_streams_and_pages import OUTCOME


def _log(spark, tmp_path, name="store"):
    return cm.CommitLog(spark, f"file://{tmp_path}/{name}")


def _ids(df):
    return sorted(r[0] for r in df.select("item_id").collect())


def test_commits(spark, tmp_path):
    log, other = _log(spark, tmp_path), _log(spark, tmp_path)
    assert log.head().number == -1
    a = spark.createDataFrame([(1,), (2,)], "item_id long")
    first = log.commit(log.head(), {"a": log.write("a", a), "b": log.write("b", a.limit(0))}, {"a": a.schema, "b": a.schema}, note="x")
    assert (first.number, log.head().number, log.head().notes) == (0, 0, {"note": "x"})
    mine, theirs = log.head(), other.head()
    written = log.write("a", a.limit(1), "more")
    assert _ids(log.read("a")) == [1, 2] and _ids(log.read("b")) == []  # what is not committed is not there
    log.commit(mine, {"a": written})
    with pytest.raises(cm.Conflict):
        other.commit(theirs, {"b": other.write("b", a)})
    assert len(_ids(other.read("a"))) == 3 and _ids(other.read("b")) == [] and _ids(other.read("a", first)) == [1, 2]

    def attempt():
        base = other.head()
        if base.number == 1:  # another writer comes first, once
            log.commit(log.head(), {"a": {"more": None}})
        return other.commit(base, {"b": other.write("b", a)})

    assert cm.retried(attempt).number == 3 and _ids(other.read("b")) == [1, 2] and _ids(other.read("a")) == [1, 2]
    assert log.vacuum(1) == 2 and _ids(log.read("a")) == [1, 2] and _ids(log.read("b")) == [1, 2]


def _files(log, entry, table):
    root = log.path.removeprefix("file://")
    return {p: sorted((f, os.stat(f"{root}/{folder}/{f}").st_mtime_ns) for f in os.listdir(f"{root}/{folder}")) for p, folder in entry.tables[table].items()}


def test_a_small_batch_leaves_other_parts_alone(spark, tmp_path):
    log, part = _log(spark, tmp_path), cm.id_part(width=100)
    items = _items(spark, [dict(item_id=k, title=f"t{k}", status="active", view_count=k) for k in range(1000)])
    base = cm.create_parts(log, "items", items, part)
    listing = "page int, pos int, item_id long, url string, title string, creator_name string, thumbnail_url string, view_count long, favorite_count long"
    batch = spark.createDataFrame([(1, k, 990 + k, "u", f"new {k}", None, None, 5, 6) for k in range(12)], listing)
    changes, touched = cm.merge_parts(log, base, "items", batch, part, lambda old: mg.merge_listing(old, batch, T0))
    head = log.commit(base, {"items": changes})
    assert touched == ["10", "9"] and set(head.tables["items"]) == {str(k) for k in range(11)}
    before, after = _files(log, base, "items"), _files(log, head, "items")
    assert all(before[str(k)] == after[str(k)] for k in range(9)) and before["9"] != after["9"]
    assert all(base.tables["items"][str(k)] == head.tables["items"][str(k)] for k in range(9))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(log.read("items", head)) == key(mg.merge_listing(items, batch, T0).select(*items.columns))
    assert key(log.read("items", base)) == key(items)  # the old entry is there for who reads it


def test_a_quiet_refresh_writes_recent_months_only(spark, tmp_path):
    log = _log(spark, tmp_path)
    now = dt.datetime.fromisoformat(T0)
    days = [now - dt.timedelta(days=5 * k) for k in range(100)]
    items = _items(spark, [dict(item_id=k, status="active", view_count=k, published_at=d) for k, d in enumerate(days)] + [dict(item_id=500, status="active")])
    items = mg.refresh_hot(items, now - dt.timedelta(days=1))
    part = F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit("none"))
    base = cm.create_parts(log, "items", items, part)
    recent = items.where(F.col("published_at") >= F.lit(str(now - dt.timedelta(days=mg.RECENT_DAYS))).cast("timestamp_ntz"))
    changes, touched = cm.merge_parts(log, base, "items", recent, part, lambda old: mg.refresh_hot(old, T0, full=False))
    head = log.commit(base, {"items": changes})
    assert len(touched) <= 3 < len(head.tables["items"])
    assert sum(base.tables["items"][p] != f for p, f in head.tables["items"].items()) == len(touched)
    want = {r.item_id: r.hot_score for r in mg.refresh_hot(items, T0, full=False).collect()}
    assert {r.item_id: r.hot_score for r in log.read("items", head).collect()} == want


ROWS = [(1, "ok", 1, "u1", None, "A", (3, "C", None), None, None, 5, 6, None), (2, "missing", 2, "u2", *[None] * 8), (7, "error", 3, "u7", *[None] * 7, "boom"), (5000, "ok", 4, "u", None, "N", None, None, None, 1, 1, None)]


@pytest.mark.parametrize("step", ["runs", "items", "ledger"])
def test_a_stream_that_breaks_off(spark, tmp_path, step):
    """Stopped after any write of any epoch and started again, a stream leaves what the batch function gives; readers never see half an epoch."""
    items = _items(spark, [dict(item_id=1, title="a", status="active"), dict(item_id=2, title="b", status="active"), dict(item_id=3000, title="far", status="active")])
    ledger = spark.createDataFrame([], FAILURES)
    log = _log(spark, tmp_path)
    created = apply.create_store(log, items, ledger, width=1000)
    for k, row in enumerate(ROWS):
        spark.createDataFrame([row], OUTCOME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    broken = []

    def stop(epoch, at):
        seen = log.head()
        assert log.read("runs", seen).count() == epoch and seen.notes.get("epoch of outcomes", -1) == epoch - 1
        if at == step and epoch in (0, 2) and epoch not in broken:
            broken.append(epoch)
            raise RuntimeError("stopped")

    for _ in range(3):
        source = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = apply.stream_commits(source, log.path, str(tmp_path / "cp"), T0, between=stop)
        try:
            query.awaitTermination(180)
        except StreamingQueryException:
            continue
    assert broken == [0, 2]
    head = log.head()
    assert head.number == created.number + len(ROWS) and head.tables["items"]["3"] == created.tables["items"]["3"]  # item 3000 was not touched
    want_items, want_ledger = apply.apply_outcomes(items, ledger, spark.createDataFrame(ROWS, OUTCOME), T0)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(log.read("items", head)) == key(want_items.select(*items.columns)) and key(log.read("ledger", head)) == key(want_ledger.select(*ledger.columns))
    assert [r.details_fetched + r.missing_items + r.failed_details for r in log.read("runs", head).collect()] == [1] * 4
    again = apply.apply_epoch(log, spark.createDataFrame(ROWS, OUTCOME), 3, T0)  # a repeated epoch
    assert again.number == head.number


def test_an_epoch_of_unreadable_details_changes_no_item(spark, tmp_path):
    items, log = _items(spark, [dict(item_id=1, title="a", status="active")]), _log(spark, tmp_path)
    apply.create_store(log, items, spark.createDataFrame([], FAILURES))
    rows = [(1, "missing", 1, "u1", *[None] * 8)] + [(k, "drift", k, f"u{k}", *[None] * 8) for k in range(2, 8)]
    head = apply.apply_epoch(log, spark.createDataFrame(rows, OUTCOME), 0, T0)
    assert [(r.title, r.status) for r in log.read("items", head).collect()] == [("a", "active")]
    assert log.read("ledger", head).count() == 6 and log.read("runs", head).first().status == "failed"
