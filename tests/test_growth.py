"""What must not grow with the tables: rows that the index shuffles, memory of a task."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import related
from tessera.operators import segments as sg
from tessera.operators.commits import CommitLog
from tessera.operators.filters import active
from tessera.operators.related import related_items
from tessera.operators.scoring import popularity
from tessera.operators.search import postings
from tessera.plans import base as b
from tessera.plans.queries import queries
from tessera.sources import html as hx
from tessera.sources.tables import orders_catalog

from .catalog import build
from .test_segments import _docs


def test_bitmaps_are_the_postings(spark):
    rows = {k: (t, w) for k, (t, w) in zip((-70_000, -1, 0, 5, 32768, 32769, 10**9, 2**40), (("", ""), ("ab", "a"), ("Café 夏の海", "灯台 x"), ("🙂🙂🙂🙂", "z"), ("abcabcabc", "abc abc"), ("a\x00b", "q"), (None, "ﬀ ß"), ("x" * 5000, "y, é")))}
    docs = _docs(spark, rows)
    got = sg.bitmaps(docs).select("posting", F.explode(sg.members("bits", "block")).alias("item_id")).collect()
    want = postings(docs).collect()
    assert len(got) == len(want) and {(r.posting, r.item_id) for r in got} == {(r.posting, r.item_id) for r in want}
    plan = sg.bitmaps(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "RepartitionByExpression" in plan  # documents are dealt, not postings


def test_links_are_dealt_once_before_they_are_exploded(spark):
    plan = orders_catalog(spark, "/root/testdata/sf0.001").links._jdf.queryExecution().executedPlan().toString()
    exploded = plan[: plan.index("Generate explode")]
    assert "Exchange hashpartitioning" not in exploded


def test_only_texts_beyond_ascii_go_to_python(spark):
    seen = spark.createDataFrame([("Plain words",), ("Café",), (None,)], "t string")
    assert [sorted(r[0]) for r in seen.select(tx.words(F.col("t"))).collect()] == [["plain", "words"], ["cafe"], []]
    assert "rlike" in seen.select(tx.words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_partitions_follow_the_tables(spark, monkeypatch):
    before = spark.conf.get(b._INITIAL, None)
    monkeypatch.setattr(b, "PER_PARTITION", 1 << 12)
    try:
        b.read_model(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(b._INITIAL)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(b._INITIAL, before) if before else spark.conf.unset(b._INITIAL)


def test_batches_for_python_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        queries()["page_outcomes"](spark, "/root/testdata/sf0.001")
        long = spark.range(400).select(F.repeat(F.lit("x"), 100_000).alias("t")).coalesce(1)
        sizes = long.mapInArrow(lambda batches: (b.select(["t"]).slice(0, 1).set_column(0, "n", pa.array([b.num_rows])) for b in batches), "n long").collect()
        assert len(sizes) > 5 and sum(r.n for r in sizes) == 400 and max(r.n for r in sizes) < 100
        spark.conf.set(name, "1m")
        queries()["page_outcomes"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_plain_pages_are_read_without_the_general_parser():
    """The short way makes the tree that ``HTMLParser`` makes, and takes the pages of the queries; other markup goes to the parser."""
    def general(html):
        builder = hx._Builder()
        builder.feed(html)
        builder.close()
        return builder.root

    flat = lambda e: [x if isinstance(x, str) else (x.tag, x.attrs, list(x.classes), flat(x)) for x in e.children]
    rnd = random.Random(3)
    plain = ["<p>", "</p>", '<a class="box  big" href="/x?a=1">', "</a>", "<br>", "</div>", '<div class="video-h1">', "x > y ", "A &amp; B", "&lt", "&"]
    odd = ["<!-- <b> -->", "<br/>", "<", "</", "<a href='x'>", '<a title="<b>">', "<p x>", "</div >", "<script>", "</script>", "<title>", "<P>", '</p class="x">', '<i a="&amp;">']
    for k in range(3000):
        page = "".join(rnd.choice(plain if k % 2 or rnd.random() < 0.9 else odd) for _ in range(rnd.randrange(40)))
        assert flat(hx._tree(page)) == flat(general(page))
        assert k % 2 == 0 or hx._plain_tree(page) is not None
    deep = "<p>" * (hx.DEEPEST + 9) + "x" + "</p>" * 20 + "<b>y</b>"
    assert flat(hx._plain_tree(deep)) == flat(general(deep))


def test_a_kind_of_page_is_read_by_itself(spark):
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    assert hx._read(pages, "detail").columns == ["page_id", "url", "detail"]
    plans = [hx.extract_listings(pages, "https://example.com", ("example.com",)), hx.extract_details(pages, "https://example.com", ("example.com",), ()).select("title", "tags", "outcome")]
    assert not any("ArrowEvalPython" in x._jdf.queryExecution().executedPlan().toString() for x in plans)  # one pass of Python, no second one for NFKC


def test_related_pairs_are_in_no_hash_table(spark):
    """What a task holds of pairs must not grow with its share of the links."""
    sources = spark.range(0, 600, 2).select(F.col("id").alias("item_id"))
    out = related_items(orders_catalog(spark, "/root/testdata/sf0.001"), sources, pairs=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "DenseRank" in plan or "dense_rank" in plan
    assert not re.search(r"Aggregate\(keys=\[source_id#\d+L?, item_id", plan)


def test_links_of_a_crowded_entity_are_not_one_tasks(spark, monkeypatch):
    """Neither those of a hot creator nor those of an origin that the cap leaves out (at a join on entities they would be sorted in one task)."""
    monkeypatch.setattr(related, "CROWD", 150, raising=False)
    monkeypatch.setattr(related, "FEW", 0)
    monkeypatch.setattr(related, "PUSHED", 0)
    items = [(k, "x", 7 if k < 300 else None, None, k, 0, "active") for k in range(400)]
    c = build(spark, items, [("authors", 7, "hot")], [(k, "origins", 3) for k in range(400)] + [(k, "tags", k // 4) for k in range(400)])
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as for large tables
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        for sources in (None, spark.range(0, 400, 2).select(F.col("id").alias("item_id"))):
            rows = related.usable_links(c, sources).select("*", F.spark_partition_id().alias("task")).collect()
            assert sorted((r.item_id, r.code // 4, r.n) for r in rows) == sorted([(k, 7, 300) for k in range(300)] + [(k, k // 4, 4) for k in range(400)])
            assert len({r.task for r in rows if r.n == 300}) > 1
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_what_a_task_reads_is_bounded(spark):
    """A task that takes more of a larger table holds more: Spark joins partitions up to 64 MB again, and files up to 128 MB, unless told."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for asked, want in (("64MB", 8 << 20), ("1MB", 1 << 20)):
            for n in names:
                spark.conf.set(n, asked)
            b.read_model(spark, "/root/testdata/sf0.001")
            got = [spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(n)) for n in names]
            assert max(got) <= want and (asked == "64MB" or min(got) == want)
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_hits_of_frequent_tokens_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A bitmap of a few bytes is thousands of items, so what Spark knows of its size must not decide on a broadcast of the items."""
    index = sg.SegmentIndex(CommitLog(spark, f"file://{tmp_path}/index"))
    index.add(_docs(spark, {k: ("harbour", "x") for k in range(300)}))
    tokens = spark.createDataFrame([("harbour",), ("x",)], "token string")
    plans = []
    for most in (299, 300):
        monkeypatch.setattr(sg, "FEW_HITS", most, raising=False)
        out = index.hits(tokens)
        assert sorted((r.token, r.item_id) for r in out.collect()) == [(t, k) for t in ("harbour", "x") for k in range(300)]
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"SortMergeJoin \[segment#\d+, item_id", plans[0]) and not re.search(r"HashJoin \[segment#\d+, item_id", plans[0])
    assert "BroadcastHashJoin [segment#" in plans[1]


def test_related_rows_below_the_floor_stay_where_they_are_met(spark, monkeypatch):
    """Who has enough neighbours by a creator is told nothing of a tag on many items; rounds give the same rows."""
    n = 600
    items = [(k, "x", k // 20, None, k * 7919 % n, 0, "active") for k in range(n)]
    c = build(spark, items, [("authors", k, f"a{k}") for k in range(n // 20)], [(k, "tags", k % 6) for k in range(n)])
    made = active(c.items).select("item_id", popularity().alias("popularity"))
    found, _ = related.candidates(related.usable_links(c, None), made, None, 12, light=50)
    assert found.count() == 12 * n
    rows = lambda: sorted(map(tuple, related_items(c, limit=12, light=50).collect()))
    want = []
    for s in range(n):
        score = {o: 10 * (o // 20 == s // 20) + (o % 6 == s % 6) for o in range(n) if o != s}
        first = sorted((o for o in score if score[o]), key=lambda o: (-score[o], -(o * 7919 % n), -o))[:12]
        want += [(s, r, o, score[o]) for r, o in enumerate(first, 1)]
    assert rows() == want
    monkeypatch.setattr(related, "ROUND", 250)
    assert rows() == want


def test_an_index_leaves_little_on_disk(spark, tmp_path):
    """Words are not dealt whole, and texts are packed."""
    index = sg.SegmentIndex(CommitLog(spark, f"file://{tmp_path}/index"))
    docs = _docs(spark, {k: ("harbour lantern", "x") for k in range(20)})
    assert "substring" in sg.bitmaps(docs)._jdf.queryExecution().optimizedPlan().toString()
    index.add(docs)
    files = [f.name for f in tmp_path.rglob("part-*.parquet")]
    assert files and all(".zstd." in f for f in files)
