import datetime as dt

from tessera.operators.merge import current, publish
from tessera.schema import FAILURES
from tessera.sources import html as hx
from tessera.streaming.access import access_rollup
from tessera.streaming.apply import apply_outcomes, stream_outcomes

from .test_incremental import T0, _items

REF = "struct<id:bigint,name:string,url:string>"
OUTCOME = f"item_id long, outcome string, seq long, url string, video_url string, title string, creator {REF}, thumbnail_url string, published_at timestamp_ntz, view_count long, favorite_count long, comment string"


def test_stream_of_outcomes_equals_batch(spark, tmp_path):
    items = _items(spark, [dict(item_id=1, title="a", status="active"), dict(item_id=2, title="b", status="active")])
    rows = [(1, "ok", 1, "u1", None, "A", (3, "C", None), None, None, 5, 6, None), (2, "missing", 2, "u2", *[None] * 8), (7, "error", 3, "u7", *[None] * 7, "boom")]
    outcomes = spark.createDataFrame(rows, OUTCOME)
    outcomes.write.parquet(str(tmp_path / "in"))
    publish(items, str(tmp_path / "c/items"), 0)
    publish(spark.createDataFrame([], FAILURES), str(tmp_path / "c/ledger"), 0)
    q = stream_outcomes(spark.readStream.schema(OUTCOME).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "cp"), T0)
    q.awaitTermination(120)
    batch_items, batch_ledger = apply_outcomes(items, spark.createDataFrame([], FAILURES), outcomes, T0)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(current(spark, str(tmp_path / "c/items"))) == key(batch_items)
    assert key(current(spark, str(tmp_path / "c/ledger"))) == key(batch_ledger)
    assert batch_ledger.first().entity_id == "7"
    run = current(spark, str(tmp_path / "c/runs")).first()
    assert (run.run_id, run.status, run.details_fetched, run.missing_items, run.failed_details) == (0, "partial", 1, 1, 1)


def test_a_batch_of_unreadable_details_changes_no_item(spark, tmp_path):
    items = _items(spark, [dict(item_id=1, title="a", status="active")])
    rows = [(1, "missing", 1, "u1", *[None] * 8)] + [(k, "drift", k, f"u{k}", *[None] * 8) for k in range(2, 8)]
    spark.createDataFrame(rows, OUTCOME).write.parquet(str(tmp_path / "in"))
    publish(items, str(tmp_path / "c/items"), 0)
    publish(spark.createDataFrame([], FAILURES), str(tmp_path / "c/ledger"), 0)
    stream_outcomes(spark.readStream.schema(OUTCOME).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "cp"), T0).awaitTermination(120)
    assert [(r.title, r.status) for r in current(spark, str(tmp_path / "c/items")).collect()] == [("a", "active")]
    assert current(spark, str(tmp_path / "c/ledger")).count() == 6 and current(spark, str(tmp_path / "c/runs")).first().status == "failed"


def test_access_rollup_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(t + dt.timedelta(seconds=40 * k), "GET", "/", 500 if k % 7 == 0 else 200, k / 100) for k in range(60)]
    schema = "ts timestamp_ntz, method string, route string, status int, duration double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    q = access_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("rolled").collect())) == sorted(map(str, access_rollup(spark.read.parquet(str(tmp_path / "log"))).collect()))


#: Class names, icons, the placeholder's title and its date are fixed values of the pages to read.
LISTING = """<div class="g-main-grid"><article><a class="box" href="/movies/11"><h2 class="box-h2">One  A</h2><img class="main-thumbnail" src="//cdn.example.com/1.jpg">
<div class="box-text1"><span class="box-text-in">Maker</span></div><span class="figure-text-in">8.2k</span><span class="figure-text-in">31</span></a></article>
<article><a class="box" href="https://evil.com/movies/12"></a></article><article><p>no link</p></article></div><ul class="pagination"><a class="page-link" href="?page=9">9</a></ul>"""
DETAIL = """<html><head><title>x</title><meta property="og:image" content="https://example.com/i.png"></head><body><h1 class="video-h1">Title</h1><ul class="video-views">
<li><span class="video-text">2030-06-15</span><span class="video-text">18:07</span></li><li class="f-label-in"><i class="material-icons">remove_red_eye</i><span class="video-text">40,961</span></li>
<li class="f-label-in"><i class="material-icons">favorite</i><span class="video-text">7.3k</span></li></ul><section class="video-section-tag"><a href="/authors/3">face Maker</a><a href="/tags/5"><span class="tag-text">Five</span></a>
<a href="/tags/5">again</a><a href="/tags/6">local_offer Six</a><a href="javascript:/tags/7">bad</a></section><a class="video-watch-btn2" href="https://evil.com/v"></a><a class="video-watch-btn2" href="https://www.video.tv/v"></a>
<blockquote class="video-information-comment">hi\\nthere</blockquote></body></html>"""
GONE = """<title>|俺の3Dエロ動画</title><ul class="video-views"><li><span class="video-text">-0001-11-30</span><span class="video-text">00:00</span></li>
<li class="f-label-in"><i class="material-icons">remove_red_eye</i><span class="video-text">0</span></li><li class="f-label-in"><i class="material-icons">favorite</i><span class="video-text">0</span></li></ul>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "https://example.com/list", LISTING), (2, "https://example.com/movies/2", DETAIL), (3, "https://example.com/movies/3", GONE), (4, "u", None), (5, None, "<<p")], "page_id long, url string, html string")
    rows = hx.extract_listings(pages, "https://example.com", ("example.com",)).collect()
    assert [(r.item_id, r.title, r.creator_name, r.view_count, r.favorite_count, r.last_page, r.thumbnail_url) for r in rows] == [(11, "One A", "Maker", 8200, 31, 9, "https://cdn.example.com/1.jpg")]
    out = {r.item_id: r for r in hx.extract_details(pages, "https://example.com", ("example.com",), ("video.tv",)).collect()}
    d = out[2]
    assert (d.outcome, d.title, d.creator.name, [(x.id, x.name) for x in d.tags], d.view_count, d.favorite_count) == ("ok", "Title", "Maker", [(5, "Five"), (6, "Six")], 40961, 7300)
    assert (d.video_url, d.published_at, d.comment) == ("https://www.video.tv/v", dt.datetime(2030, 6, 15, 18, 7), "hi\nthere")
    assert [out[k].outcome for k in (1, 3, 4, 5)] == ["drift", "missing", "drift", "drift"]
    assert {(r.listing, r.detail) for r in hx.page_outcomes(pages, "https://example.com", ("example.com",)).collect()} == {("ok", "drift"), ("drift", "ok"), ("drift", "missing"), ("drift", "drift")}
