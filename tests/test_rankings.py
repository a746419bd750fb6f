"""Statistics, rankings, autocomplete and related items against plain Python on random catalogues."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import rankings as rk
from tessera.operators.filters import active
from tessera.operators.related import candidates, related_items, usable_links
from tessera.operators.scoring import popularity
from tessera.schema import KINDS, Catalog

from .catalog import NOW, WEIGHTS, World, build


@pytest.fixture(scope="module")
def world(spark):
    w = World(spark, 29)
    return w, rk.entity_stats(w.catalog, str(NOW)).cache()


def _stats(w):
    """{(kind, id): (items, views, favorites, popularity)} of entities on active items."""
    out = defaultdict(lambda: [0, 0, 0, 0])
    for i in w.active():
        x = w.items[i]
        for kind in KINDS:
            for e in w.of(i, kind):
                out[kind, e] = [a + b for a, b in zip(out[kind, e], (1, x["views"] or 0, x["favorites"] or 0, w.popularity(i)), strict=True)]
    return out


def _ranked(w, kinds):
    s = _stats(w)
    return [k for k in sorted(s, key=lambda k: (-s[k][3], -s[k][2], -s[k][0], w.names[k], *k)) if k[0] in kinds]


def test_statistics_and_boards(world):
    w, stats = world
    want = _stats(w)
    got = {(r.kind, r.entity_id): [r.item_count, r.total_views, r.total_favorites, r.popularity] for r in stats.collect()}
    assert got == dict(want)
    hot = {(r.kind, r.entity_id): r.hot for r in stats.collect()}
    for key in want:
        assert abs(hot[key] - sum(w.hot(i) for i in w.active() if key[1] in w.of(i, key[0]))) < 1e-6
    for board, kinds in (("authors", ("authors",)), ("categories", ("tags", "origins"))):
        order = _ranked(w, kinds)
        page = rk.ranking(stats, board, 4, 2).collect()
        assert [(r.kind, r.entity_id, r["rank"], r.is_top) for r in page] == [(*k, n, n <= 3) for n, k in enumerate(order, 1)][2:6]
    counts = Counter(k for k, _ in want)
    assert {r.board: r.n for r in rk.ranking_counts(stats).collect()} == {**counts, "categories": counts["tags"] + counts["origins"]}
    boards = defaultdict(list)
    for r in rk.leaderboards(stats, 3).orderBy("rank").collect():
        boards[r.board].append((r.kind, r.entity_id))
    assert boards == {b: _ranked(w, k)[:3] for b, k in (("authors", ("authors",)), ("characters", ("characters",)), ("categories", ("tags", "origins")))}


def test_statistics_by_deltas(world, spark):
    """Changed, new, gone and revived items: adding their differences gives the statistics of the new catalogue."""
    w, stats = world
    other = World(spark, 30, 60)
    before, after = w.catalog, Catalog(
        w.catalog.items.where("item_id % 3 <> 0").unionByName(other.catalog.items.where("item_id % 3 = 0")), w.catalog.entities,
        w.catalog.links.where("item_id % 3 <> 0").unionByName(other.catalog.links.where("item_id % 3 = 0")),
    )
    touched = before.items.unionByName(other.catalog.items).where("item_id % 3 = 0").select("item_id")
    got = rk.updated_stats(stats, rk.entity_changes(before, after, touched, str(NOW)), w.catalog.entities).collect()
    want = {(r.kind, r.entity_id): r for r in rk.entity_stats(after, str(NOW)).collect()}
    assert {(r.kind, r.entity_id) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        x = want[r.kind, r.entity_id]
        assert r[:7] == x[:7] and abs(r.hot - x.hot) < 1e-6


def test_autocomplete(world, spark):
    w, stats = world
    popular = {e: s[3] for (k, e), s in _stats(w).items() if k == "tags"}
    names = {e: n for (k, e), n in w.names.items() if k == "tags"}

    def want(q):
        q = q.strip().lower()
        hits = [e for e in names if q in names[e].lower() and (q or e in popular)]
        return sorted(hits, key=lambda e: (bool(q) and not names[e].lower().startswith(q), -popular.get(e, 0), names[e], e))[:4]

    queries = ["", "ta", "TA3", "a", "海 t", "%", "e", "zz", " w"]
    for q in queries:
        assert [r.entity_id for r in rk.autocomplete(w.catalog, stats, "tags", q, 4).collect()] == want(q), q
    batch = defaultdict(list)
    for r in rk.autocomplete_batch(w.catalog, stats, "tags", spark.createDataFrame([(q,) for q in queries], "query string"), 4).orderBy("rank").collect():
        batch[r["query"]].append(r.entity_id)
    assert batch == {q.strip().lower(): want(q) for q in queries if q.strip() and want(q)}


def test_top_items(world):
    w, _ = world
    got = defaultdict(list)
    for r in rk.top_items_per_creator(w.catalog, n=2).orderBy("rank").collect():
        got[r.creator_id].append(r.item_id)
    want = defaultdict(list)
    for i in sorted(w.active(), key=lambda i: (-w.popularity(i), -i)):
        if w.items[i]["creator"] is not None:
            want[w.items[i]["creator"]].append(i)
    assert got == {c: v[:2] for c, v in want.items()}


@pytest.mark.parametrize(("light", "most"), [(100, 6), (1, 12), (3, 2), (0, 1), (5, 3)])
def test_related(world, light, most):
    w, _ = world
    active, got = set(w.active()), defaultdict(list)
    for r in related_items(w.catalog, limit=5, light=light, most=most).orderBy("source_id", "rank").collect():
        got[r.source_id].append((r.item_id, r.score))
    want = {}
    for a in active:
        score = {b: sum(WEIGHTS[k] * len(w.of(a, k) & w.of(b, k)) for k in KINDS) for b in active - {a}}
        want[a] = [(b, score[b]) for b in sorted(score, key=lambda b: (-score[b], -w.popularity(b), -b)) if score[b]][:5]
    assert got == {a: v for a, v in want.items() if v}


@pytest.mark.parametrize("share", [2, 7])
def test_related_of_sources_at_once_and_by_lists(world, spark, share):
    w, _ = world
    sources = spark.createDataFrame([(i,) for i in sorted(w.items) if i % share == 0] * 2, "item_id long")
    rows = lambda **how: sorted(map(tuple, related_items(w.catalog, sources, limit=4, **how).collect()))
    want = sorted(tuple(r) for r in related_items(w.catalog, limit=4).collect() if r.source_id % share == 0)
    assert want and rows() == rows(pairs=0) == rows(pairs=0, light=1) == want
    assert related_items(w.catalog, sources.limit(0)).collect() == []


def test_related_ignores_entities_on_too_many_items(spark):
    n = 140
    items = [(k, f"item {k}", None, None, k, 0, "active") for k in range(n)]
    links = [(k, "tags", 8) for k in range(n)] + [(k, "characters", 9) for k in (3, 50, 77, 90)]
    out = related_items(build(spark, items, [("tags", 8, "everywhere"), ("characters", 9, "rare")], links)).collect()
    assert {(r.source_id, r.item_id, r.score) for r in out} == {(a, b, 5) for a in (3, 50, 77, 90) for b in (3, 50, 77, 90) if a != b}


@pytest.mark.parametrize("pairs", [0, 10_000])
def test_related_sources_with_more_heavy_entities_than_lists_take(spark, pairs):
    """Source 0 is no member of lists; what shares two of its entities is alone in its list."""
    links = [(k, "characters", e) for e in range(5) for k in [0, *range(10 * e + 1, 10 * e + 9)]] + [(99, "characters", 1), (99, "characters", 2)]
    items = [(k, "x", None, None, k, 0, "active") for k in sorted({i for i, _, _ in links})]
    c = build(spark, items, [("characters", e, f"c{e}") for e in range(5)], links)
    out = related_items(c, spark.createDataFrame([(0,)], "item_id long"), limit=3, light=2, most=3, pairs=pairs).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in out] == [(99, 10), (48, 5), (47, 5)]


def test_related_rows_grow_with_sources(spark):
    """A creator of a third of all items, a tag at the cap and characters on many: a bounded number of candidates for each source."""
    n = 3000
    items = [(k, f"item {k}", 7 if k % 3 == 0 else 1000 + k, None, k * 7919 % n, 0, "active") for k in range(n)]
    links = [(k, "tags", 1) for k in range(150)] + [(k, "characters", k * 31 % 11) for k in range(n) if k % 20 == 0] + [(k, "tags", 10 + k // 5) for k in range(n)]
    c = build(spark, items, [("authors", 7, "hot")], links)
    c.links = c.links.distinct()
    made = active(c.items).select("item_id", popularity().alias("popularity"))
    found, _ = candidates(usable_links(c, None), made, None, 12)
    assert found.count() < 40 * n  # a third of the items alone makes n * n / 9 pairs
    got = defaultdict(list)
    for r in related_items(c).orderBy("source_id", "rank").collect():
        got[r.source_id].append((r.item_id, r.score))
    owners, counts = defaultdict(set), Counter((kind, e) for _, kind, e in {(i, k, e) for i, k, e in links})
    for i, kind, e in {*links, *((r[0], "authors", r[2]) for r in items)}:
        if kind == "authors" or counts[kind, e] <= n // 20:
            owners[kind, e].add(i)
    for source in range(0, n, 97):
        score = Counter()
        for (kind, _), members in owners.items():
            if source in members:
                score.update(dict.fromkeys(members - {source}, WEIGHTS[kind]))
        want = sorted(score.items(), key=lambda x: (-x[1], -(x[0] * 7919 % n), -x[0]))[:12]
        assert got[source] == want


def test_related_rows_of_items_with_seven_heavy_entities(spark):
    """Every item has seven entities that are on about a hundred items each: the first of each, not all that share one, are candidates."""
    n, each = 3000, 160
    links = sorted({(k, "tags", (k * 7919 + j * j * 613 + k // 160 * j) % each) for k in range(n) for j in range(7)})
    items = [(k, "x", None, None, k * 7919 % n, 0, "active") for k in range(n)]
    c = build(spark, items, [("tags", e, f"t{e}") for e in range(each)], links)
    made = active(c.items).select("item_id", popularity().alias("popularity"))
    found, _ = candidates(usable_links(c, None), made, None, 12)
    assert found.count() < 250 * n  # all that share an entity are about 900 for an item
    got, owners, of = defaultdict(list), defaultdict(set), defaultdict(set)
    for r in related_items(c).orderBy("source_id", "rank").collect():
        got[r.source_id].append((r.item_id, r.score))
    for i, _, e in links:
        owners[e].add(i)
        of[i].add(e)
    for source in range(0, n, 37):
        score = Counter(o for e in of[source] if len(owners[e]) <= n // 20 for o in owners[e] - {source})
        assert got[source] == sorted(score.items(), key=lambda x: (-x[1], -(x[0] * 7919 % n), -x[0]))[:12]


def test_autocomplete_of_names_with_a_common_prefix(spark):
    """A hundred thousand names begin alike: shares are bounded, and the first names are those of a loop over all."""
    n = 100_000
    names = spark.range(n).select(F.lit("tags").alias("kind"), F.col("id").alias("entity_id"), F.concat(F.lit("Common "), F.col("id").cast("string")).alias("name"))
    stats = names.select("kind", "entity_id", "name", (F.col("entity_id") * 7919 % 1009).alias("popularity"))
    queries = ["common", "c", "co", "common 99", "ommon 5", "77777", "zzz", "n 1", "COMMON 42"]
    out = rk.autocomplete_batch(Catalog(None, names, None), stats, "tags", spark.createDataFrame([(q,) for q in queries], "query string"), limit=4, share=3000)
    got = defaultdict(list)
    for r in out.orderBy("rank").collect():
        got[r.query].append(r.entity_id)
    for q in {q.lower() for q in queries}:
        low = [(k, f"common {k}") for k in range(n)]
        want = sorted((not name.startswith(q), -(k * 7919 % 1009), f"Common {k}", k) for k, name in low if q in name)[:4]
        assert got[q] == [x[3] for x in want]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
