"""The index of segments against plain rows: deltas, replaced and removed items, compaction, files that a delta leaves alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import segments as sg
from tessera.operators.commits import CommitLog
from tessera.operators.documents import build_search_docs, short_terms
from tessera.operators.search import postings, search_batch, token_hits

from .catalog import WORDS, World


def _docs(spark, rows):
    """rows: {id: (title, keywords)}."""
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "item_id long, title string, keywords string")
    return short_terms(df.withColumn("title_folded", F.lower(F.coalesce("title", F.lit("")))).withColumn("keywords_folded", F.lower("keywords")))


@pytest.fixture
def index(spark, tmp_path):
    return sg.SegmentIndex(CommitLog(spark, f"file://{tmp_path}/index"))


TOKENS = ["harbour", "arb", "orchid", "夏", "の海", "灯台", "café", "ca", "a", "ü", "b1", "#", "zzz", "xy", "%", "copper ember", "drift"]


def _found(df):
    return sorted((r.token, r.item_id) for r in df.collect())


def test_deltas_equal_a_new_index(spark, index):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5)))
    tokens = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    state = {k: (text() if k % 9 else None, text()) for k in [*rnd.sample(range(1, 200_000), 60), 0, -1, -5, 32768, 32769, 2**40]}
    index.add(_docs(spark, state))
    for step in range(4):
        batch = {k: (text(), text()) for k in [*rnd.sample(sorted(state), 7), *rnd.sample(range(200_000, 300_000), 5)]}
        state |= batch
        index.add(_docs(spark, batch))
        if step == 1:
            gone = rnd.sample(sorted(state), 5)
            index.remove(spark.createDataFrame([(k,) for k in gone], "item_id long"))
            state = {k: v for k, v in state.items() if k not in gone}
        if step == 2:
            back = {gone[0]: ("harbour again", "")}
            state |= back
            index.add(_docs(spark, back))
        want = _found(token_hits(tokens, _docs(spark, state)))
        assert _found(index.hits(tokens)) == want and len({t for t, _ in want}) > 8
        assert sorted(r.item_id for r in index.docs().collect()) == sorted(state)
    many = spark.createDataFrame([(f"w{k}",) for k in range(300)], "token string").unionByName(tokens)  # more postings than are pushed down
    assert _found(index.hits(many)) == want
    before = index.log.head()
    assert len(before.tables["docs"]) == 6
    after = index.compact(force=True)
    assert len(after.tables["docs"]) == len(after.tables["postings"]) == 1 and not after.tables["gone"]
    assert _found(index.hits(tokens)) == want == _found(index.hits(tokens, before)) and sorted(r.item_id for r in index.docs().collect()) == sorted(state)
    assert index.compact(force=True).number == after.number  # one segment stays
    index.add(_docs(spark, {7: ("harbour", "")}))
    assert (("harbour", 7) in _found(index.hits(tokens))) and len(index.log.head().tables["docs"]) == 2
    assert index.compact().number == index.log.head().number and len(index.log.head().tables["docs"]) == 2  # a small delta is left as it is


def test_a_delta_writes_its_documents_only(spark, index):
    first = index.add(_docs(spark, {k: (f"harbour number {k}", "lantern") for k in range(500)}))
    root = index.log.path.removeprefix("file://")
    files = lambda e: {f: sorted((x, os.stat(f"{root}/{f}/{x}").st_mtime_ns) for x in os.listdir(f"{root}/{f}")) for parts in e.tables.values() for f in parts.values()}
    before = files(first)
    second = index.add(_docs(spark, {3: ("velvet", ""), 900: ("velvet harbour", "")}))
    after = files(second)
    assert all(after[f] == before[f] for f in before)
    delta = spark.read.parquet(*(f"{index.log.path}/{f}" for f in second.tables["postings"].values() if f not in before))
    assert delta.select(F.sum(F.bitmap_count("bits"))).first()[0] == postings(_docs(spark, {3: ("velvet", ""), 900: ("velvet harbour", "")})).count()
    whole = index.log.read("postings", first)
    assert whole.count() * 10 < postings(_docs(spark, {k: (f"harbour number {k}", "lantern") for k in range(500)})).count()  # a row for many items
    assert _found(index.hits(spark.createDataFrame([("velvet",), ("number 3",)], "token string")))[-2:] == [("velvet", 3), ("velvet", 900)]


def test_nothing(spark, index):
    index.add(_docs(spark, {1: ("x", "")}).limit(0))
    assert index.docs().count() == 0 and _found(index.hits(spark.createDataFrame([("harbour",)], "token string"))) == []


def test_batch_search_by_segments(spark, index):
    w = World(spark, 31)
    docs = build_search_docs(w.catalog)
    index.add(docs)
    schema = "query_id string, tokens array<string>, title_mode string, facets array<struct<kind:string,mode:string,ids:array<bigint>>>"
    rows = [(f"{mode} {k}", t.lower().split(), mode, []) for mode in ("all", "any") for k, t in enumerate(["harbour", "夏 a", "orchid velvet", "の海", "ü", "#", "xy zzz", ""])]
    requests = spark.createDataFrame(rows, schema)
    key = lambda df: sorted((r.query_id, r.item_id) for r in df.collect())
    assert key(search_batch(w.catalog, requests, hits_of=index.hits)) == key(search_batch(w.catalog, requests, docs))
