"""Search against a plain Python model on random catalogues and requests."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import filters as fl
from tessera.operators import search as se
from tessera.operators.documents import build_search_docs
from tessera.operators.scoring import with_scores
from tessera.schema import SORT_MODES, SearchRequest

from .catalog import NOW, World

BATCH = (
    "query_id string, tokens array<string>, title_mode string, facets array<struct<kind:string,mode:string,ids:array<bigint>>>, published_from string, published_to string, "
    "min_views long, max_views long, min_favorites long, max_favorites long, sort string"
)


@pytest.fixture(scope="module")
def world(spark):
    w = World(spark, 17)
    c = w.catalog
    c.items = with_scores(c.items, str(NOW)).cache()
    c.links = c.links.cache()
    return w, c, build_search_docs(c).cache()


@pytest.mark.parametrize("order", SORT_MODES)
def test_orders(world, order):
    w, c, _ = world
    page = se.search(c, SearchRequest(order=order), page_size=100)
    assert [r.item_id for r in page.items.collect()] == w.found(SearchRequest(order=order))


def test_random_requests_alone_and_in_a_batch(world, spark):
    w, c, docs = world
    requests = [w.request() for _ in range(150)]
    want = {f"q{k}": w.found(r) for k, r in enumerate(requests)}
    assert sum(0 < len(v) < 40 for v in want.values()) > 40
    for k, r in list(enumerate(requests))[:25]:
        page = se.search(c, r, page_size=100, docs=docs)
        assert [x.item_id for x in page.items.collect()] == want[f"q{k}"] and page.total == len(want[f"q{k}"])
    rows = []
    for k, r in enumerate(requests):
        low = lambda c, r=r: r.counts.get(c, (None, None))[0]
        high = lambda c, r=r: r.counts.get(c, (None, None))[1]
        facets = [(kind, mode, ids) for (kind, mode), ids in r.facets.items()]
        rows.append((f"q{k}", r.text.split(), r.match, facets, *r.days, low("view_count"), high("view_count"), low("favorite_count"), high("favorite_count"), r.order))
    batch = spark.createDataFrame(rows, BATCH)
    found = se.search_batch(c, batch, docs).cache()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}
    pages = {}
    for r in se.batch_pages(c, found, batch, 5).orderBy("query_id", "rank").collect():
        pages.setdefault(r.query_id, []).append(r.item_id)
    assert pages == {q: v[:5] for q, v in want.items() if v}


def test_cap_and_pages(world):
    w, c, _ = world
    n = len(w.active())
    cap = n - 7
    last = se.search(c, SearchRequest(), page=1000, page_size=9, max_results=cap)
    assert (last.total, last.capped, last.page, last.page_count) == (cap, True, -(-cap // 9), -(-cap // 9))
    seen = [r.item_id for p in range(1, -(-n // 9) + 1) for r in se.search(c, SearchRequest(), page=p, page_size=9).items.collect()]
    assert sorted(seen) == sorted(w.active())


def test_letters_and_their_accents(spark):
    docs = spark.createDataFrame([(1, "Zoë's ÉTUDE, n°5"), (2, "zoo étude"), (3, "雪の etude")], "item_id long, t string")
    docs = docs.select("item_id", F.lower("t").alias("title_folded"), F.lit("").alias("keywords_folded"), tx.cjk_grams(F.col("t")).alias("grams"), tx.words(F.col("t")).alias("words"))
    find = lambda token: [r.item_id for r in docs.where(fl.token_matches(token)).orderBy("item_id").collect()]
    assert find("étu") == [1, 2] and find("etu") == [3] and find("et") == [1, 2, 3] and find("ÉT") == [1, 2, 3] and find("zo") == [1, 2] and find("の") == [3] and find("雪の") == [3] and find("_") == []


def test_cjk_grams(spark):
    text = "x漢字カナ y 漢 字カ"
    row = spark.createDataFrame([(text,)], "t string").select(tx.cjk_grams(F.col("t")).alias("g")).first()
    want = []
    for run in text.replace("x", " ").replace("y", " ").split():
        want += [g for k in range(len(run)) for g in (run[k], run[k : k + 2])]
    assert row.g == list(dict.fromkeys(want))


def test_details_links_and_resolve(world, spark):
    w, c, _ = world
    some = sorted(w.items)[:9]
    for r in se.item_details(c, spark.createDataFrame([(i,) for i in some], "item_id long")).collect():
        for kind in ("tags", "origins", "characters"):
            assert [(x.name, x.entity_id) for x in r[kind]] == sorted((w.names[kind, e], e) for e in w.of(r.item_id, kind))
        creator = w.items[r.item_id]["creator"]
        assert r.creator_name == (w.names["authors", creator] if creator is not None else "")
    known = [e for k, e in w.names if k == "origins"]
    wanted = spark.createDataFrame([(k, "origins", e) for k, e in enumerate([*known[::-1], -5, known[0]])], "pos int, kind string, entity_id long")
    assert [r.entity_id for r in se.resolve_entities(c, wanted).orderBy("pos").collect()] == [*known[::-1], known[0]]
