"""The registered catalogue queries, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..functions.workers import bound_batches, share_path, shared_root, stored
from ..operators import commits as cm
from ..operators import filters as fl
from ..operators import incremental as inc
from ..operators import merge as mg
from ..operators import monitoring as mon
from ..operators import rankings as rk
from ..operators import search as se
from ..operators.documents import build_search_docs, search_document
from ..operators.ranks import RankFiles
from ..operators.related import related_items
from ..operators.scoring import ntz, with_scores
from ..operators.segments import SegmentIndex
from ..schema import FAILURES, Catalog, SearchRequest
from ..sources import html as hx
from ..sources.tables import table
from ..streaming.access import access_rollup
from ..streaming.alerts import late_rows, stream_alerts
from ..streaming import apply
from ..streaming.apply import apply_outcomes, create_store
from . import base as b
from .base import AS_OF, EVENTS_NOW, FAIL_SQL, LOG_SQL, PAGES_SQL, RICH_SQL, WITH

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_path(spark)
            bound_batches(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run, sql
        return f

    return keep


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active items of two creators by popularity, first page."""
    c = b.catalog(spark, sf_dir)
    c.items = with_scores(c.items, AS_OF)
    return se.search(c, SearchRequest(facets={("authors", "any"): [1, 2]}, order="popularity_desc")).items.select("item_id", "title", "popularity")


# ---------------------------------------------------------------- search

_ORDER = {
    "published_desc": "published_at DESC NULLS LAST, item_id DESC", "published_asc": "published_at ASC NULLS FIRST, item_id ASC",
    "hot_desc": "hot_score DESC NULLS LAST, item_id DESC", "popularity_desc": "popularity DESC NULLS LAST, item_id DESC",
    "favorites_desc": "favorite_count DESC NULLS LAST, published_at DESC NULLS LAST, item_id DESC", "favorites_asc": "favorite_count ASC NULLS FIRST, published_at ASC NULLS FIRST, item_id ASC",
    "views_desc": "view_count DESC NULLS LAST, published_at DESC NULLS LAST, item_id DESC", "views_asc": "view_count ASC NULLS FIRST, published_at ASC NULLS FIRST, item_id ASC",
}


def _sorted(mode: str, offset: int = 36) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranks = b.read_model(spark, sf_dir).ranks()
        return ranks.first(mode, 36, offset).rows.select("item_id", "title", "view_count", "favorite_count")

    return run


for _mode, _by in _ORDER.items():
    query(f"search_{_mode}", f"{WITH} SELECT item_id, title, view_count, favorite_count FROM active ORDER BY {_by} LIMIT 36 OFFSET 36")(_sorted(_mode))
@query("search_deepest_page", f"""{WITH}, r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER['views_desc']}) AS n, least(count(*) OVER (), 10000) AS total FROM active)
SELECT item_id, title, view_count, favorite_count FROM r WHERE n > (greatest(total, 1) - 1) // 36 * 36 AND n <= (greatest(total, 1) - 1) // 36 * 36 + 36""")
def search_deepest_page(spark, sf_dir):
    """The last page within the cap of 10,000 results."""
    ranks = b.read_model(spark, sf_dir).ranks()
    last = (max(min(ranks.count("views_desc"), 10_000), 1) - 1) // 36
    return ranks.first("views_desc", 36, last * 36).rows.select("item_id", "title", "view_count", "favorite_count")



@query("search_top_filtered", f"""{WITH} SELECT item_id, title, view_count, favorite_count FROM active WHERE item_id NOT IN (SELECT item_id FROM links WHERE kind = 'origins' AND entity_id IN (3, 4))
  AND view_count <= 150000 ORDER BY {_ORDER['hot_desc']} LIMIT 36""")
def search_top_filtered(spark, sf_dir):
    """The first page of a filtered order, from as many files as it takes."""
    model = b.read_model(spark, sf_dir)
    c, request = model.catalog(), SearchRequest(facets={("origins", "not"): [3, 4]}, counts={"view_count": (None, 150_000)}, order="hot_desc")
    top = model.ranks().first("hot_desc", 36, keep=lambda rows: fl.apply_filters(Catalog(rows, c.entities, c.links), request))
    return top.rows.select("item_id", "title", "view_count", "favorite_count")


@query("search_top_after_delta", f"""{RICH_SQL}, now AS (SELECT i.* REPLACE (coalesce(b.view_count, i.view_count) AS view_count) FROM items i LEFT JOIN batch b USING (item_id) WHERE status = 'active'
  UNION ALL BY NAME SELECT item_id, title, view_count, favorite_count, NULL::TIMESTAMP AS published_at FROM batch WHERE item_id NOT IN (SELECT item_id FROM items))
SELECT item_id, title, view_count, favorite_count FROM now ORDER BY {_ORDER['favorites_desc']} LIMIT 500""")
def search_top_after_delta(spark, sf_dir):
    """A listing enters a layout as a segment of its own; older copies of its items are passed over."""
    items = b.catalog(spark, sf_dir).items
    batch = b.listing_batch(b.rich_items(b.catalog(spark, sf_dir))).select("item_id", F.col("title").alias("_title"), F.col("view_count").alias("_views"), F.col("favorite_count").alias("_favorites"))
    changed = batch.join(items, "item_id", "left").select(
        "item_id", F.col("_title").alias("title"), "creator_id", "creator_display_name", "published_at", F.col("_views").alias("view_count"), F.col("_favorites").alias("favorite_count"), F.coalesce("status", F.lit("active")).alias("status")
    )
    ranks = RankFiles(cm.CommitLog(spark, f"{shared_root(spark)}/ranks-{uuid.uuid4().hex}"))
    scored = lambda rows: with_scores(rows.select(*changed.columns), AS_OF)
    ranks.build(scored(items), ["favorites_desc"])
    ranks.update(scored(changed))
    return ranks.first("favorites_desc", 500).rows.select("item_id", "title", "view_count", "favorite_count")


@query("capped_count", f"{WITH} SELECT least(count(*), 5000)::BIGINT AS total, count(*) > 5000 AS is_capped, greatest(1, ceil(least(count(*), 5000) / 36.0))::BIGINT AS page_count FROM active")
def capped_count(spark, sf_dir):
    return se.capped_count(fl.active(b.catalog(spark, sf_dir).items), 5000, 36)


def _found(request: SearchRequest) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = b.read_model(spark, sf_dir)
        return fl.apply_filters(model.catalog(), request, model.docs() if request.text else None).select("item_id")

    return run


def _ids(kind: str, ids: str) -> str:
    return f"(SELECT item_id FROM links WHERE kind = '{kind}' AND entity_id IN ({ids}))"


for _name, _request, _where in (
    ("facet_creator_any", SearchRequest(facets={("authors", "any"): [1, 2, 3, 500]}), f"item_id IN {_ids('authors', '1, 2, 3, 500')}"),
    ("facet_tag_any", SearchRequest(facets={("tags", "any"): [10, 11, 12]}), f"item_id IN {_ids('tags', '10, 11, 12')}"),
    ("facet_creator_not", SearchRequest(facets={("authors", "not"): [1, 2, 3]}), f"item_id NOT IN {_ids('authors', '1, 2, 3')}"),
    ("facet_tag_not", SearchRequest(facets={("tags", "not"): [10, 11, 12]}), f"item_id NOT IN {_ids('tags', '10, 11, 12')}"),
    ("facet_origin_any_character_not", SearchRequest(facets={("origins", "any"): [3, 4], ("characters", "not"): [1, 2, 3], ("tags", "not"): [9]}, counts={"view_count": (1000, None)}), f"item_id IN {_ids('origins', '3, 4')} AND item_id NOT IN {_ids('characters', '1, 2, 3')} AND item_id NOT IN {_ids('tags', '9')} AND view_count >= 1000"),
    ("range_date", SearchRequest(days=("1998-03-01", "1998-03-31")), "published_at >= DATE '1998-03-01' AND published_at < DATE '1998-04-01'"),
    ("range_counts", SearchRequest(counts={"view_count": (50_000, 150_000), "favorite_count": (None, 80)}), "coalesce(view_count, 0) BETWEEN 50000 AND 150000 AND coalesce(favorite_count, 0) <= 80"),
    ("text_all", SearchRequest(text="URGENT build"), "contains(lower(title), 'urgent') AND contains(lower(title), 'build')"),
    ("text_any", SearchRequest(text="machinery nation_7", match="any"), f"contains(lower(title), 'machinery') OR item_id IN {_ids('origins', '7')}"),
    ("text_short_prefix", SearchRequest(text="bu 1"), "regexp_matches(lower(title), '(^|[^a-z0-9])bu') AND (regexp_matches(title, '(^|[^A-Za-z0-9])1') OR item_id IN (SELECT item_id FROM links JOIN entities USING (kind, entity_id) WHERE regexp_matches(name, '(^|[^A-Za-z0-9])1')))"),
):
    query(_name, f"{WITH} SELECT item_id FROM active WHERE {_where}")(_found(_request))


@query("facet_tag_all", f"""{WITH}, pair AS (SELECT min(entity_id) AS a, max(entity_id) AS b FROM links WHERE kind = 'tags' AND item_id = (SELECT min(item_id) FROM (SELECT item_id FROM links JOIN active USING (item_id) WHERE kind = 'tags' GROUP BY 1 HAVING count(*) > 1)))
SELECT item_id FROM active, pair WHERE item_id IN (SELECT item_id FROM links WHERE kind = 'tags' AND entity_id = a) AND item_id IN (SELECT item_id FROM links WHERE kind = 'tags' AND entity_id = b)""")
def facet_tag_all(spark, sf_dir):
    """Two tags of the first active item that has several."""
    c = b.catalog(spark, sf_dir)
    tags = c.links.where("kind = 'tags'").join(fl.active(c.items).select("item_id"), "item_id", "left_semi")
    pair = tags.groupBy("item_id").agg(F.min("entity_id").alias("a"), F.max("entity_id").alias("b")).where("a < b").orderBy("item_id").limit(1).collect()
    ids = [pair[0]["a"], pair[0]["b"]] if pair else [0, 1]
    return fl.apply_filters(c, SearchRequest(facets={("tags", "all"): ids})).select("item_id")


@query("lookup_keys", f"{WITH} SELECT item_id, title, status FROM items WHERE item_id IN (3, 5, 8, 1200)")
def lookup_keys(spark, sf_dir):
    return fl.lookup(b.catalog(spark, sf_dir).items, [3, 5, 8, 1200]).select("item_id", "title", "status")


@query("name_contains", f"{WITH} SELECT kind, entity_id, name FROM entities WHERE contains(lower(name), 'red')")
def name_contains(spark, sf_dir):
    return fl.name_contains(b.catalog(spark, sf_dir).entities, "RED").select("kind", "entity_id", "name")


@query("search_document", f"""{WITH}, names AS (
  SELECT item_id, string_agg(name, ' ' ORDER BY name) FILTER (kind = 'characters') AS c, string_agg(name, ' ' ORDER BY name) FILTER (kind = 'origins') AS o, string_agg(name, ' ' ORDER BY name) FILTER (kind = 'tags') AS t
  FROM links JOIN entities USING (kind, entity_id) GROUP BY item_id)
SELECT item_id, title, trim(coalesce(creator_display_name, '') || ' ' || coalesce(c, '') || ' ' || coalesce(o, '') || ' ' || coalesce(t, '')) AS keywords FROM items LEFT JOIN names USING (item_id)""")
def search_documents(spark, sf_dir):
    return search_document(b.catalog(spark, sf_dir))


@query("short_terms", """SELECT doc_id AS item_id, list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))), 'string_agg', ' ') AS words
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]')""")
def short_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.array_join(F.array_sort(tx.words(F.col("text"))), " ").alias("words"))


#: Documents get CJK characters for some of their letters, as the tables have none.
_LETTERS, _SIGNS = "abcdefghij", "あいウエ漢字한글東京"


@query("cjk_grams", f"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_SIGNS}'), '[{_SIGNS}]+')) AS run FROM documents),
grams AS (SELECT DISTINCT doc_id, run[i:least(i + n, length(run))] AS gram FROM (SELECT doc_id, run, unnest(range(1, length(run) + 1)) AS i FROM runs), (VALUES (0), (1)) v(n)),
counted AS (SELECT doc_id, count(*) AS n, string_agg(gram, ' ' ORDER BY gram) AS grams FROM grams GROUP BY 1)
SELECT doc_id AS item_id, coalesce(n, 0)::INT AS n_grams, coalesce(grams, '') AS grams FROM documents LEFT JOIN counted USING (doc_id)""")
def cjk_grams(spark, sf_dir):
    grams = tx.cjk_grams(F.translate("text", _LETTERS, _SIGNS))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.size(grams).alias("n_grams"), F.array_join(F.array_sort(grams), " ").alias("grams"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each nation and market segment of its customers: a long and a short token, all of them for even nations; the nation as
    origin for two of three; a supplier barred; a range of days or of views; every sort mode."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nation = F.col("c_nationkey")
    facet = lambda kind, mode, c: F.struct(F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.array(c.cast("long")).alias("ids"))
    barred = facet("characters", "not", nation)
    return customers.select(
        F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("query_id"), F.array("c_mktsegment", F.lit("ur")).alias("tokens"), F.when(nation % 2 == 0, "all").otherwise("any").alias("title_mode"),
        F.when(nation % 3 < 2, F.array(facet("origins", "any", nation), barred)).otherwise(F.array(barred)).alias("facets"),
        F.when(nation % 4 == 1, "1996-06-01").otherwise("").alias("published_from"), F.when(nation % 5 == 2, F.lit(100_000)).cast("long").alias("max_views"),
        F.element_at(F.array(*(F.lit(m) for m in _ORDER)), (nation % len(_ORDER) + 1).cast("int")).alias("sort"),
    )


_BATCH_SQL = f"""{WITH}, requests AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS seg FROM customer),
texts AS (SELECT item_id, lower(coalesce(title, '')) AS t, lower(coalesce(creator_display_name, '') || ' ' || coalesce(names, '')) AS kw FROM items LEFT JOIN (SELECT item_id, string_agg(name, ' ') AS names FROM links JOIN entities USING (kind, entity_id) WHERE kind <> 'authors' GROUP BY 1) USING (item_id)),
words_ AS (SELECT seg, item_id, contains(t, lower(seg)) OR contains(kw, lower(seg)) AS long_, regexp_matches(t || ' ' || kw, '(^|[^a-z0-9])ur') AS short_ FROM texts, (SELECT DISTINCT seg FROM requests)),
batch AS (SELECT k || ':' || seg AS query_id, k, a.* FROM requests r JOIN words_ w USING (seg) JOIN active a USING (item_id)
  WHERE CASE WHEN k % 2 = 0 THEN long_ AND short_ ELSE long_ OR short_ END AND (k % 3 = 2 OR EXISTS (SELECT 1 FROM links l WHERE l.item_id = a.item_id AND l.kind = 'origins' AND l.entity_id = k))
  AND NOT EXISTS (SELECT 1 FROM links x WHERE x.item_id = a.item_id AND x.kind = 'characters' AND x.entity_id = k)
  AND (k % 4 <> 1 OR published_at >= DATE '1996-06-01') AND (k % 5 <> 2 OR coalesce(view_count, 0) <= 100000))"""


@query("search_batch", f"{_BATCH_SQL} SELECT query_id, item_id FROM batch")
def search_batch(spark, sf_dir):
    model = b.read_model(spark, sf_dir)
    return se.search_batch(model.catalog(), _requests(spark, sf_dir), hits_of=model.segments().hits)


@query("search_batch_pages", f"{_BATCH_SQL} SELECT query_id, rank, item_id FROM ("
    + " UNION ALL ".join(f"SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY {by})::INT AS rank FROM batch WHERE k % {len(_ORDER)} = {n}" for n, by in enumerate(_ORDER.values())) + ") WHERE rank <= 36")
def search_batch_pages(spark, sf_dir):
    model, requests = b.read_model(spark, sf_dir), _requests(spark, sf_dir)
    c = model.catalog()
    found = se.search_batch(c, requests, hits_of=model.segments().hits)
    c.items = with_scores(c.items, AS_OF)
    return se.batch_pages(c, found, requests)


_TOKENS = ("relisted", "building", "ur", "urgent", "#", "customer#00000001")


@query("search_after_delta", f"""{RICH_SQL}, names AS (SELECT item_id, string_agg(name, ' ') AS names FROM links JOIN entities USING (kind, entity_id) WHERE kind <> 'authors' GROUP BY 1),
texts AS (SELECT coalesce(r.item_id, b.item_id) AS item_id, lower(CASE WHEN b.item_id IS NULL THEN r.title ELSE 'Relisted ' || b.title END) AS t,
  lower(coalesce(c.c_name, CASE WHEN b.item_id IS NULL THEN r.creator_display_name ELSE b.creator_name END, '') || ' ' || coalesce(names, '')) AS kw
  FROM rich r FULL JOIN batch b ON r.item_id = b.item_id LEFT JOIN customer c ON c.c_custkey = r.creator_id LEFT JOIN names n ON n.item_id = coalesce(r.item_id, b.item_id))
SELECT token, item_id FROM texts, (VALUES {', '.join(f"('{t}')" for t in _TOKENS)}) v(token)
WHERE CASE WHEN length(token) > 2 THEN contains(t, token) OR contains(kw, token) ELSE token = 'ur' AND regexp_matches(t || ' ' || kw, '(^|[^a-z0-9])ur') END""")
def search_after_delta(spark, sf_dir):
    """A listing with new titles and new items is merged and indexed as a delta; tokens are then searched in all segments."""
    model = b.read_model(spark, sf_dir)
    c = model.catalog()
    rich = b.rich_items(c)
    batch = stored(b.listing_batch(rich).withColumn("title", F.concat(F.lit("Relisted "), "title")))
    merged = Catalog(mg.merge_listing(rich, batch, NOW), c.entities, c.links)
    index = SegmentIndex(cm.CommitLog(spark, f"{shared_root(spark)}/segments-{uuid.uuid4().hex}"))
    index.add(model.docs())
    index.add(build_search_docs(merged, batch.select("item_id")))
    return index.hits(spark.createDataFrame([(t,) for t in _TOKENS], "token string"))


_CJK_TOKENS = ("漢", "한漢", "東", "エ東", "ウ한")


@query("search_cjk", f"""{WITH} SELECT token, item_id FROM (SELECT item_id, translate(lower(coalesce(title, '')), '{_LETTERS}', '{_SIGNS}') AS t FROM items), (VALUES {', '.join(f"('{t}')" for t in _CJK_TOKENS)}) v(token) WHERE contains(t, token)""")
def search_cjk(spark, sf_dir):
    """Short CJK tokens in titles that have CJK characters for some of their letters."""
    c = b.catalog(spark, sf_dir)
    index = SegmentIndex(cm.CommitLog(spark, f"{shared_root(spark)}/segments-{uuid.uuid4().hex}"))
    index.add(build_search_docs(Catalog(c.items.withColumn("title", F.translate(F.lower("title"), _LETTERS, _SIGNS)), c.entities, c.links)))
    return index.hits(spark.createDataFrame([(t,) for t in _CJK_TOKENS], "token string"))


_RAW = """raw AS (SELECT event_id AS query_id, '  Foo,' || event_type || ' bar' AS q, CASE event_type WHEN 'view' THEN 'any' WHEN 'click' THEN 'some' ELSE 'all' END AS title_mode,
  user_id || ',x, ' || user_id || ',7' AS tag_any, CASE WHEN event_type = 'error' THEN 'abc' ELSE user_id || ',000' END AS min_views,
  CASE event_type WHEN 'view' THEN 'hot' WHEN 'click' THEN 'sideways' WHEN 'error' THEN 'views_asc' ELSE 'popularity' END AS sort, user_id AS page FROM events)"""


def _raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), F.concat(F.lit("  Foo,"), kind, F.lit(" bar")).alias("q"),
        F.when(kind == "view", "any").when(kind == "click", "some").otherwise("all").alias("title_mode"), F.concat(user, F.lit(",x, "), user, F.lit(",7")).alias("tag_any"),
        F.when(kind == "error", "abc").otherwise(F.concat(user, F.lit(",000"))).alias("min_views"),
        F.when(kind == "view", "hot").when(kind == "click", "sideways").when(kind == "error", "views_asc").otherwise("popularity").alias("sort"), F.col("user_id").alias("page"),
    )


@query("normalise_queries", f"""WITH {_RAW} SELECT query_id, 'Foo ' || split_part(split_part(q, ',', 2), ' ', 1) || ' bar' AS tokens, CASE title_mode WHEN 'any' THEN 'any' ELSE 'all' END AS title_mode,
  CASE WHEN page = 7 THEN '7' ELSE page || ',7' END AS tag_any, CASE WHEN min_views <> 'abc' THEN page * 1000 END::BIGINT AS min_views,
  CASE sort WHEN 'hot' THEN 'hot_desc' WHEN 'sideways' THEN 'published_desc' WHEN 'popularity' THEN 'popularity_desc' ELSE sort END AS sort, page < 1 AS rejected FROM raw""")
def normalise_queries(spark, sf_dir):
    from ..operators.requests import normalise

    r = normalise(_raw_requests(spark, sf_dir))
    return r.select("query_id", F.array_join("tokens", " ").alias("tokens"), "title_mode", F.array_join("tag_any", ",").alias("tag_any"), "min_views", "sort", "rejected")


@query("canonical_queries", f"""WITH {_RAW}, canonical AS (SELECT concat_ws('&', 'q=' || trim(q), 'sort=' || CASE sort WHEN 'hot' THEN 'hot_desc' WHEN 'sideways' THEN NULL WHEN 'popularity' THEN 'popularity_desc' ELSE sort END,
  'tag_any=' || CASE WHEN page = 7 THEN '7' ELSE page || ',7' END, CASE WHEN title_mode = 'any' THEN 'title_mode=any' END, CASE WHEN min_views <> 'abc' THEN 'min_views=' || page * 1000 END) AS c, min_views <> 'abc' AS ranged FROM raw)
SELECT md5(list_aggregate(list_sort(string_split(c, '&')), 'string_agg', '&')) AS canonical, (1 + ranged::INT) AS active_filters, count(*) AS n FROM canonical GROUP BY 1, 2""")
def canonical_queries(spark, sf_dir):
    from ..operators.requests import canonical, normalise

    c = canonical(normalise(_raw_requests(spark, sf_dir)))
    return c.groupBy(F.md5("canonical").alias("canonical"), "active_filters").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- projections


@query("scores", f"{WITH} SELECT i.item_id, i.popularity, round(coalesce(hot_score, 0), 6) AS hot_score FROM items i LEFT JOIN active a USING (item_id)")
def scores(spark, sf_dir):
    return with_scores(b.catalog(spark, sf_dir).items, AS_OF).select("item_id", "popularity", F.round("hot_score", 6).alias("hot_score"))


@query("item_cards", f"{WITH} SELECT item_id, title, creator_id, coalesce(e.name, creator_display_name, '') AS creator_name, published_at, coalesce(view_count, 0) AS view_count, coalesce(favorite_count, 0) AS favorite_count, status FROM items LEFT JOIN entities e ON e.kind = 'authors' AND e.entity_id = creator_id")
def item_cards(spark, sf_dir):
    return se.cards(b.catalog(spark, sf_dir))


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["entity_id"])), ",").alias(c)


_AGG = "coalesce(string_agg(name || ':' || entity_id, ',' ORDER BY name, entity_id) FILTER (kind = '{0}'), '') AS {0}"


@query("item_details", f"""{WITH}, named AS (SELECT item_id, {', '.join(_AGG.format(k) for k in ('tags', 'origins', 'characters'))} FROM links JOIN entities USING (kind, entity_id) GROUP BY 1)
SELECT item_id, title, creator_display_name AS creator_name, status, coalesce(tags, '') AS tags, coalesce(origins, '') AS origins, coalesce(characters, '') AS characters FROM items LEFT JOIN named USING (item_id)""")
def item_details(spark, sf_dir):
    return se.item_details(b.catalog(spark, sf_dir)).select("item_id", "title", "creator_name", "status", *map(_joined, ("tags", "origins", "characters")))


@query("item_links", f"{WITH} SELECT item_id, string_agg(name || ':' || entity_id, ',' ORDER BY name, entity_id) AS links FROM links JOIN entities USING (kind, entity_id) WHERE kind = 'tags' GROUP BY 1")
def item_links(spark, sf_dir):
    return se.item_links(b.catalog(spark, sf_dir), "tags").select("item_id", _joined("links"))


@query("resolve_entities", f"{WITH} SELECT o_orderkey AS pos, 'tags' AS kind, entity_id, name FROM orders JOIN entities ON kind = 'tags' AND entity_id = o_custkey")
def resolve_entities(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.lit("tags").alias("kind"), F.col("o_custkey").alias("entity_id"))
    return se.resolve_entities(b.catalog(spark, sf_dir), wanted)


# ---------------------------------------------------------------- rankings

_STATS = "kind, entity_id, name, item_count, total_views, total_favorites, popularity"
_RANK = "popularity DESC, total_favorites DESC, item_count DESC, name, kind, entity_id"
_RANK_COLS = ("kind", "entity_id", "name", "item_count", "total_views", "total_favorites", "popularity")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.read_model(spark, sf_dir).stats()


@query("entity_stats", f"{WITH} SELECT {_STATS}, round(hot, 4) AS hot FROM stats")
def entity_stats(spark, sf_dir):
    return rk.entity_stats(b.catalog(spark, sf_dir), AS_OF).withColumn("hot", F.round("hot", 4))


@query("ranking_counts", f"{WITH} SELECT board, count(*) AS n FROM (SELECT kind AS board FROM stats UNION ALL SELECT 'categories' FROM stats WHERE kind IN ('tags', 'origins')) GROUP BY 1")
def ranking_counts(spark, sf_dir):
    return rk.ranking_counts(_stats(spark, sf_dir))


def _board(board: str, offset: int) -> Query:
    return lambda spark, sf_dir: rk.ranking(_stats(spark, sf_dir), board, 60, offset).select(*_RANK_COLS, "rank", "is_top")


for _name, _kinds, _offset in (("authors", "'authors'", 60), ("categories", "'tags', 'origins'", 0)):
    query(f"ranking_{_name}", f"{WITH} SELECT {_STATS}, rank, rank <= 3 AS is_top FROM (SELECT *, row_number() OVER (ORDER BY {_RANK})::INT AS rank FROM stats WHERE kind IN ({_kinds})) WHERE rank > {_offset} AND rank <= {_offset + 60}")(_board(_name, _offset))


@query("leaderboards", f"{WITH} SELECT board, rank, {_STATS} FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY {_RANK}) AS rank FROM (SELECT *, CASE WHEN kind IN ('tags', 'origins') THEN 'categories' ELSE kind END AS board FROM stats)) WHERE rank <= 12")
def leaderboards(spark, sf_dir):
    return rk.leaderboards(_stats(spark, sf_dir)).select("board", "rank", *_RANK_COLS)


@query("rank_share", f"{WITH}, page AS (SELECT * FROM stats WHERE kind = 'characters' ORDER BY {_RANK} LIMIT 60) SELECT entity_id, round(popularity / greatest(max(popularity) OVER (), 1), 6) AS share FROM page")
def rank_share(spark, sf_dir):
    return rk.rank_share(rk.ranking(_stats(spark, sf_dir), "characters")).select("entity_id", F.round("share", 6).alias("share"))


@query("top_items_per_creator", f"{WITH} SELECT creator_id, rank, item_id, popularity FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY popularity DESC, item_id DESC) AS rank FROM active) WHERE rank <= 8")
def top_items_per_creator(spark, sf_dir):
    return rk.top_items_per_creator(b.catalog(spark, sf_dir))


@query("autocomplete", f"{WITH} SELECT e.entity_id, e.name FROM entities e LEFT JOIN stats s USING (kind, entity_id) WHERE e.kind = 'tags' AND contains(lower(e.name), 'red') ORDER BY starts_with(lower(e.name), 'red') DESC, coalesce(s.popularity, 0) DESC, e.name, e.entity_id LIMIT 10")
def autocomplete(spark, sf_dir):
    return rk.autocomplete(b.catalog(spark, sf_dir), _stats(spark, sf_dir), "tags", "Red")


@query("autocomplete_empty", f"{WITH} SELECT entity_id, name FROM stats WHERE kind = 'authors' ORDER BY popularity DESC, name, entity_id LIMIT 10")
def autocomplete_empty(spark, sf_dir):
    return rk.autocomplete(b.catalog(spark, sf_dir), _stats(spark, sf_dir), "authors")


@query("autocomplete_batch", f"""{WITH}, queries AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS query FROM part)
SELECT query, rank, entity_id, name FROM (SELECT query, e.entity_id, e.name, row_number() OVER (PARTITION BY query ORDER BY starts_with(lower(e.name), query) DESC, coalesce(s.popularity, 0) DESC, e.name, e.entity_id) AS rank
  FROM queries JOIN entities e ON e.kind = 'tags' AND contains(lower(e.name), query) LEFT JOIN stats s USING (kind, entity_id)) WHERE rank <= 10""")
def autocomplete_batch(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query"))
    return rk.autocomplete_batch(b.catalog(spark, sf_dir), _stats(spark, sf_dir), "tags", queries)


# ---------------------------------------------------------------- related

_RELATED = """{with_}, cap AS (SELECT greatest(100, count(*) // 20) AS cap FROM active),
sized AS (SELECT kind, entity_id, count(*) AS n FROM links JOIN active USING (item_id) GROUP BY 1, 2),
usable AS (SELECT l.* FROM links l JOIN active USING (item_id) JOIN sized z ON z.kind = l.kind AND z.entity_id = l.entity_id, cap WHERE l.kind = 'authors' OR z.n <= cap),
scored AS (SELECT s.item_id AS source_id, o.item_id, sum(CASE s.kind WHEN 'authors' THEN 10 WHEN 'tags' THEN 1 ELSE 5 END)::BIGINT AS score
  FROM usable s JOIN usable o ON o.kind = s.kind AND o.entity_id = s.entity_id AND o.item_id <> s.item_id WHERE {where} GROUP BY 1, 2)
SELECT source_id, rank, item_id, score FROM (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, popularity DESC, c.item_id DESC) AS rank FROM scored c JOIN active a ON a.item_id = c.item_id) WHERE rank <= 12"""


@query("related_items", _RELATED.format(with_=WITH, where="s.item_id = (SELECT min(item_id) FROM active WHERE item_id > 100)"))
def related_one(spark, sf_dir):
    c = b.catalog(spark, sf_dir)
    return related_items(c, fl.active(c.items).where("item_id > 100").agg(F.min("item_id").alias("item_id")))


@query("related_catalogue", _RELATED.format(with_=WITH, where="true"))
def related_catalogue(spark, sf_dir):
    """The neighbours of every item."""
    return related_items(b.catalog(spark, sf_dir))


@query("related_all", _RELATED.format(with_=WITH, where="s.item_id % 50 = 0"))
def related_all(spark, sf_dir):
    """Every item whose id is divisible by 50 is a query against all items."""
    return related_items(b.catalog(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("item_id")))


# ---------------------------------------------------------------- merges

NOW = "2002-01-01 00:00:00"
_ITEM_COLS = ("item_id", "url", "title", "creator_id", "creator_display_name", "thumbnail_url", "published_at", "view_count", "favorite_count", "comment", "status", "list_seen_at", "detail_fetched_at", "created_at", "updated_at")
_NOW = f"TIMESTAMP '{NOW}'"


@query("classify_listing", f"""{RICH_SQL} SELECT b.item_id, r.item_id IS NULL AS is_new,
  r.item_id IS NULL OR r.status <> 'active' OR b.title IS DISTINCT FROM r.title OR b.thumbnail_url IS DISTINCT FROM r.thumbnail_url OR b.view_count IS DISTINCT FROM r.view_count OR b.favorite_count IS DISTINCT FROM r.favorite_count AS list_changed,
  r.item_id IS NULL OR r.status <> 'active' OR r.detail_fetched_at IS NULL AS needs_detail FROM batch b LEFT JOIN rich r USING (item_id)""")
def classify_listing(spark, sf_dir):
    rich = b.rich_items(b.catalog(spark, sf_dir))
    return mg.classify_listing(rich, b.listing_batch(rich))


_MERGED_LISTING = f"""{RICH_SQL} SELECT coalesce(r.item_id, b.item_id) AS item_id, coalesce(b.url, r.url) AS url, CASE WHEN b.item_id IS NULL THEN r.title ELSE b.title END AS title, r.creator_id,
  CASE WHEN b.item_id IS NULL THEN r.creator_display_name ELSE b.creator_name END AS creator_display_name, coalesce(b.thumbnail_url, r.thumbnail_url) AS thumbnail_url, r.published_at,
  CASE WHEN b.item_id IS NULL THEN r.view_count ELSE b.view_count END AS view_count, CASE WHEN b.item_id IS NULL THEN r.favorite_count ELSE b.favorite_count END AS favorite_count, r.comment,
  coalesce(r.status, 'active') AS status, CASE WHEN b.item_id IS NULL THEN r.list_seen_at ELSE {_NOW} END AS list_seen_at, r.detail_fetched_at,
  CASE WHEN r.item_id IS NULL THEN {_NOW} ELSE r.created_at END AS created_at, CASE WHEN b.item_id IS NULL THEN r.updated_at ELSE {_NOW} END AS updated_at
FROM rich r FULL JOIN batch b ON r.item_id = b.item_id"""


@query("merge_listing", _MERGED_LISTING)
def merge_listing(spark, sf_dir):
    rich = b.rich_items(b.catalog(spark, sf_dir))
    return mg.merge_listing(rich, b.listing_batch(rich), NOW).select(*_ITEM_COLS)


@query("merge_listing_parts", _MERGED_LISTING)
def merge_listing_parts(spark, sf_dir):
    """The same listing, merged into the parts of a stored table that it touches."""
    rich = b.rich_items(b.catalog(spark, sf_dir))
    log = cm.CommitLog(spark, f"{shared_root(spark)}/parts-{uuid.uuid4().hex}")
    part = cm.id_part(width=1 << 14)
    base = cm.create_parts(log, "items", rich, part)
    batch = b.listing_batch(rich)
    changes, _ = cm.merge_parts(log, base, "items", batch, part, lambda old: mg.merge_listing(old, batch, NOW))
    return log.read("items", log.commit(base, {"items": changes})).select(*_ITEM_COLS)


def _details(rich: DataFrame) -> DataFrame:
    """Detail records: for high ones again with one view more and no comment, for unspecified ones under new ids."""
    cols = lambda df, shift: df.select(
        (F.col("item_id") + shift).alias("item_id"), "url", "video_url", "title", F.struct(F.col("creator_id").alias("id"), F.concat(F.lit("by "), "creator_display_name").alias("name"), F.lit(None).cast("string").alias("url")).alias("creator"),
        F.lit(None).cast("string").alias("thumbnail_url"), "published_at", (F.col("view_count") + 1).alias("view_count"), "favorite_count", F.lit(None).cast("string").alias("comment"),
    )
    return cols(rich.where(F.col("title").startswith("2-HIGH")), 0).unionByName(cols(rich.where(F.col("title").startswith("4-NOT")), 20_000_000))


_DETAILS = f"""{RICH_SQL}, details AS (SELECT item_id + shift AS item_id, url, title, creator_id, 'by ' || creator_display_name AS creator_name, published_at, view_count + 1 AS view_count, favorite_count
  FROM (SELECT *, CASE WHEN title LIKE '2-HIGH%' THEN 0 ELSE 20000000 END AS shift FROM rich WHERE title LIKE '2-HIGH%' OR title LIKE '4-NOT%'))"""


@query("merge_detail", f"""{_DETAILS} SELECT item_id, url, title, creator_id, creator_display_name, thumbnail_url, published_at, view_count, favorite_count, comment, status, list_seen_at, detail_fetched_at, created_at, updated_at
  FROM rich WHERE item_id NOT IN (SELECT item_id FROM details)
UNION ALL SELECT d.item_id, d.url, d.title, d.creator_id, d.creator_name, r.thumbnail_url, d.published_at, d.view_count, d.favorite_count, NULL, 'active', r.list_seen_at, {_NOW}, coalesce(r.created_at, {_NOW}), {_NOW}
  FROM details d LEFT JOIN rich r USING (item_id)""")
def merge_detail(spark, sf_dir):
    rich = b.rich_items(b.catalog(spark, sf_dir))
    return mg.merge_detail(rich, _details(rich), NOW).select(*_ITEM_COLS)


@query("entity_stats_delta", f"""{_DETAILS}, items2 AS (SELECT item_id, view_count, favorite_count, published_at FROM rich WHERE status = 'active' AND item_id NOT IN (SELECT item_id FROM details) UNION ALL SELECT item_id, view_count, favorite_count, published_at FROM details),
scored AS (SELECT *, coalesce(view_count, 0) + coalesce(favorite_count, 0) * 50 AS p FROM items2), links2 AS (SELECT * FROM links UNION ALL SELECT item_id, 'authors', creator_id FROM details WHERE item_id > 20000000 AND creator_id IS NOT NULL)
SELECT l.kind, l.entity_id, e.name, count(*) AS item_count, coalesce(sum(view_count), 0)::BIGINT AS total_views, coalesce(sum(favorite_count), 0)::BIGINT AS total_favorites, sum(p)::BIGINT AS popularity,
  round(sum(p / (greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(published_at, TIMESTAMP '1970-01-01')))::DOUBLE / 3.6e9, 0.0) + 6.0)), 3) AS hot
FROM links2 l JOIN scored USING (item_id) JOIN entities e ON e.kind = l.kind AND e.entity_id = l.entity_id GROUP BY 1, 2, 3""")
def entity_stats_delta(spark, sf_dir):
    """Stored statistics after a merge of details, from the merged items' old and new rows only."""
    c = b.catalog(spark, sf_dir)
    rich = b.rich_items(c)
    details = stored(_details(rich))
    new = details.where("item_id > 20000000 and creator.id is not null").select("item_id", F.lit("authors").alias("kind"), F.col("creator.id").alias("entity_id"))
    after = Catalog(mg.merge_detail(rich, details, NOW), c.entities, c.links.unionByName(new))
    changes = rk.entity_changes(c, after, details, AS_OF)
    return rk.updated_stats(_stats(spark, sf_dir), changes, c.entities).withColumn("hot", F.round("hot", 3))


@query("merge_missing", f"""{RICH_SQL}, gone AS (SELECT item_id + CASE WHEN title LIKE '3-%' THEN 0 ELSE 30000000 END AS item_id, url FROM rich WHERE title LIKE '3-%' OR title LIKE '5-LOW%')
SELECT coalesce(r.item_id, g.item_id) AS item_id, coalesce(g.url, r.url) AS url, coalesce(r.title, '') AS title, CASE WHEN g.item_id IS NULL THEN r.status ELSE 'missing' END AS status,
  CASE WHEN g.item_id IS NULL THEN r.detail_fetched_at ELSE {_NOW} END AS detail_fetched_at, CASE WHEN r.item_id IS NULL THEN {_NOW} ELSE r.created_at END AS created_at FROM rich r FULL JOIN gone g ON r.item_id = g.item_id""")
def merge_missing(spark, sf_dir):
    rich = b.rich_items(b.catalog(spark, sf_dir))
    gone = rich.where("title like '3-%'").select("item_id", "url").unionByName(rich.where("title like '5-LOW%'").select((F.col("item_id") + 30_000_000).alias("item_id"), "url"))
    return mg.merge_missing(rich, gone, NOW).select("item_id", "url", "title", "status", "detail_fetched_at", "created_at")


@query("merge_entities", f"""{WITH}, refs AS (SELECT 'tags' AS kind, l_partkey + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1000000 END AS entity_id, l_returnflag || ' ' || l_linenumber AS name,
  CASE WHEN l_linestatus = 'O' THEN 'u' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey END AS url, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_suppkey AS seq FROM lineitem),
new AS (SELECT kind, entity_id, max_by(name, seq) AS name, max_by(url, seq) FILTER (url IS NOT NULL) AS url FROM refs GROUP BY 1, 2)
SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(n.name, o.name) AS name, n.url AS url, CASE WHEN o.kind IS NULL THEN {_NOW} END AS created_at, CASE WHEN n.kind IS NOT NULL THEN {_NOW} END AS updated_at
FROM entities o FULL JOIN new n ON o.kind = n.kind AND o.entity_id = n.entity_id""")
def merge_entities(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(
        F.lit("tags").alias("kind"), (F.col("l_partkey") + F.when(F.col("l_returnflag") == "R", 0).otherwise(1_000_000)).alias("entity_id"), F.concat_ws(" ", "l_returnflag", "l_linenumber").alias("name"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("u"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey"))).alias("url"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey")).alias("seq"),
    )
    return mg.merge_entities(b.catalog(spark, sf_dir).entities, refs, NOW)


@query("replace_links", f"""{WITH}, touched AS (SELECT item_id FROM items WHERE title LIKE '1-URGENT%'), new AS (SELECT DISTINCT item_id, 'tags' AS kind, creator_id AS entity_id FROM items WHERE title LIKE '1-URGENT%')
SELECT item_id, kind, entity_id FROM links WHERE item_id NOT IN (SELECT item_id FROM touched) UNION ALL SELECT * FROM new""")
def replace_links(spark, sf_dir):
    c = b.catalog(spark, sf_dir)
    touched = c.items.where("title like '1-URGENT%'")
    return mg.replace_links(c.links, touched, touched.select("item_id", F.lit("tags").alias("kind"), F.col("creator_id").alias("entity_id")))


@query("refresh_quiet", f"{WITH} SELECT i.item_id, round(CASE WHEN a.item_id IS NOT NULL AND i.published_at >= DATE '2001-08-02' - INTERVAL 30 DAY THEN hot_score ELSE -1 END, 6) AS hot_score FROM items i LEFT JOIN active a USING (item_id)")
def refresh_quiet(spark, sf_dir):
    old = b.catalog(spark, sf_dir).items.withColumn("hot_score", F.lit(-1.0))
    return mg.refresh_hot(old, AS_OF, full=False).select("item_id", F.round("hot_score", 6).alias("hot_score"))


@query("export_chunks", f"{WITH} SELECT (n - 1) // 500 AS chunk, (n - 1) % 500 AS pos, item_id, strftime(published_at, '%Y-%m-%d') AS lastmod FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM active)")
def export_chunks(spark, sf_dir):
    return mg.export_chunks(b.catalog(spark, sf_dir).items, 500).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("export_chunk_index", f"{WITH} SELECT (n - 1) // 500 AS chunk, count(*) AS n, strftime(max(published_at), '%Y-%m-%d') AS lastmod FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM active) GROUP BY 1")
def export_chunk_index(spark, sf_dir):
    return mg.chunk_index(mg.export_chunks(b.catalog(spark, sf_dir).items, 500)).withColumn("lastmod", F.col("lastmod").cast("string"))


# ---------------------------------------------------------------- incremental


@query("scan_cutoff", f"""{PAGES_SQL}, a AS (SELECT *, sum((NOT failed AND has_new)::INT) OVER w AS g, sum((NOT failed)::INT) OVER w AS ok FROM pages_ WINDOW w AS (ORDER BY page)),
s AS (SELECT *, sum((NOT failed AND NOT has_new)::INT) OVER (PARTITION BY g ORDER BY page) AS stable, sum(failed::INT) OVER (PARTITION BY ok ORDER BY page) AS fails FROM a),
r AS (SELECT page, CASE WHEN NOT failed AND stable >= 3 THEN 'stable' WHEN failed AND fails >= 3 THEN 'failures' WHEN page >= last_page THEN 'last_page' END AS reason FROM s)
SELECT page AS cutoff, reason FROM r WHERE reason IS NOT NULL ORDER BY page LIMIT 1""")
def scan_cutoff(spark, sf_dir):
    return inc.scan_cutoff(b.page_flags(b.listing_pages(spark, sf_dir)))


@query("resume_page", f"{PAGES_SQL} SELECT coalesce(max(page), 1)::BIGINT AS page FROM rows_ WHERE page <= 40 AND page >= 0 - 10 AND item_id IN (SELECT item_id FROM rows_ WHERE page = 3)")
def resume_page(spark, sf_dir):
    rows = b.listing_pages(spark, sf_dir)
    items = rows.groupBy("item_id").agg(F.max(F.when(F.col("page") == 3, ntz(NOW)).otherwise(ntz("2000-01-01 00:00:00"))).alias("list_seen_at"))
    return inc.resume_page(rows.select("page", "item_id"), items, NOW, checkpoint=40, target=200)


@query("contiguous_checkpoint", f"{PAGES_SQL} SELECT coalesce(max(page), 0)::BIGINT AS checkpoint FROM pages_ WHERE page < (SELECT coalesce(min(page), 1000000000) FROM pages_ WHERE failed)")
def contiguous_checkpoint(spark, sf_dir):
    return inc.contiguous_checkpoint(b.page_flags(b.listing_pages(spark, sf_dir)))


_LEDGER_COLS = "entity_type, entity_id, operation, url, error_type, error_message, attempts, last_failed_at, next_retry_at"
_LEDGER_SQL = """{fail}, early AS (SELECT * FROM batch WHERE ts < TIMESTAMP '2024-01-01 12:00:00'), late AS (SELECT * FROM batch WHERE ts >= TIMESTAMP '2024-01-29'),
one AS (SELECT entity_type, entity_id, operation, max_by(url, seq) AS url, max_by(error_type, seq) AS error_type, max_by(error_message, seq) AS error_message, count(*)::INT AS attempts,
  TIMESTAMP '2024-01-10' AS last_failed_at, TIMESTAMP '2024-01-10' + INTERVAL 1 SECOND * least(604800, 1800 * power(2, count(*) - 1))::BIGINT AS next_retry_at FROM early GROUP BY 1, 2, 3),
two AS (SELECT entity_type, entity_id, operation, max_by(url, seq) AS url, max_by(error_type, seq) AS error_type, max_by(error_message, seq) AS error_message, count(*)::INT AS n FROM late GROUP BY 1, 2, 3),
ledger AS (SELECT coalesce(o.entity_type, t.entity_type) AS entity_type, coalesce(o.entity_id, t.entity_id) AS entity_id, coalesce(o.operation, t.operation) AS operation, coalesce(t.url, o.url) AS url,
  coalesce(t.error_type, o.error_type) AS error_type, coalesce(t.error_message, o.error_message) AS error_message, (coalesce(o.attempts, 0) + coalesce(n, 0))::INT AS attempts,
  CASE WHEN n IS NULL THEN o.last_failed_at ELSE TIMESTAMP '2024-02-01' END AS last_failed_at,
  CASE WHEN n IS NULL THEN o.next_retry_at ELSE TIMESTAMP '2024-02-01' + INTERVAL 1 SECOND * least(604800, 1800 * power(2, coalesce(o.attempts, 0) + n - 1))::BIGINT END AS next_retry_at
  FROM one o FULL JOIN two t ON o.entity_id = t.entity_id)"""
_LEDGER = _LEDGER_SQL.format(fail=FAIL_SQL)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = b.failure_batch(spark, sf_dir)
    empty = spark.createDataFrame([], "entity_type string, entity_id string, operation string, url string, error_type string, error_message string, attempts int, last_failed_at timestamp_ntz, next_retry_at timestamp_ntz")
    one = inc.merge_failures(empty, batch.where(F.col("ts") < ntz("2024-01-01 12:00:00")), "2024-01-10 00:00:00")
    return inc.merge_failures(one, batch.where(F.col("ts") >= ntz("2024-01-29 00:00:00")), EVENTS_NOW)


@query("merge_failures", f"{_LEDGER} SELECT {_LEDGER_COLS} FROM ledger")
def merge_failures(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query("clear_failures", f"{_LEDGER} SELECT {_LEDGER_COLS} FROM ledger WHERE entity_id NOT IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29')")
def clear_failures(spark, sf_dir):
    done = table(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("ts") >= ntz("2024-01-29 00:00:00")))
    done = done.select(F.lit("item").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lit("detail").alias("operation"))
    return inc.clear_failures(_ledger(spark, sf_dir), done)


@query("retry_due", f"{_LEDGER} SELECT entity_id::BIGINT AS item_id, last_failed_at FROM ledger WHERE attempts < 6 AND next_retry_at <= TIMESTAMP '2024-02-01 03:00:00'")
def retry_due(spark, sf_dir):
    return inc.retry_due(_ledger(spark, sf_dir), "2024-02-01 03:00:00")


@query("missing_details", f"{RICH_SQL} SELECT item_id FROM rich WHERE status = 'active' AND detail_fetched_at IS NULL")
def missing_details(spark, sf_dir):
    return inc.missing_details(b.rich_items(b.catalog(spark, sf_dir)))


_STALE = "SELECT item_id, detail_fetched_at FROM rich WHERE status = 'active' AND detail_fetched_at < TIMESTAMP '2001-07-30' AND published_at >= DATE '2001-07-03' ORDER BY detail_fetched_at, item_id LIMIT 500"


@query("stale_details", f"{RICH_SQL} {_STALE}")
def stale_details(spark, sf_dir):
    return inc.stale_details(b.rich_items(b.catalog(spark, sf_dir)), AS_OF)


@query("work_queue", f"""{RICH_SQL}, stale AS ({_STALE}) SELECT item_id, reason FROM (SELECT item_id, min(k || reason)[2:] AS reason FROM (SELECT item_id, 0 AS k, 'missing' AS reason FROM rich WHERE status = 'active' AND detail_fetched_at IS NULL
  UNION ALL SELECT user_id, 1, 'retry' FROM events WHERE event_type = 'error' UNION ALL SELECT item_id, 2, 'stale' FROM stale) GROUP BY 1) WHERE item_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-02')""")
def work_queue(spark, sf_dir):
    rich, events = b.rich_items(b.catalog(spark, sf_dir)), table(spark, sf_dir, "events")
    user = F.col("user_id").alias("item_id")
    parts = {"missing": inc.missing_details(rich), "retry": events.where("event_type = 'error'").select(user), "stale": inc.stale_details(rich, AS_OF)}
    return inc.work_queue(parts, events.where((F.col("event_type") == "click") & (F.col("ts") < ntz("2024-01-02 00:00:00"))).select(user))


@query("quality_gate", f"""{PAGES_SQL}, p AS (SELECT page, count(*) FILTER (NOT mark) AS n_items FROM rows_ GROUP BY 1), l AS (SELECT max(page) AS last_page FROM p),
d AS (SELECT count(*) FILTER (event_type = 'error' AND value > 300) AS bad_details FROM events), q AS (SELECT count(*) FILTER (n_items = 0 AND (page = 1 OR page < last_page)) AS bad_pages FROM p, l)
SELECT bad_pages, bad_details, bad_pages > 0 OR bad_details >= 5 AS stop FROM q, d""")
def quality_gate(spark, sf_dir):
    pages = b.listing_pages(spark, sf_dir).groupBy("page").agg(F.count_if(~F.col("_mark")).alias("n_items"))
    pages = pages.join(F.broadcast(pages.agg(F.max("page").alias("last_page"))))  # one row
    details = table(spark, sf_dir, "events").select(F.when((F.col("event_type") == "error") & (F.col("value") > 300), "drift").otherwise("ok").alias("outcome"))
    return inc.quality_gate(pages, details)


_RUN_EVENTS = {"view": "items_seen", "click": "changed_items", "signup": "new_items", "purchase": "details_fetched", "error": "failed_details"}
_RUN_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RUN_EVENTS.items()) + " END"
_RUN_COUNTS = ", ".join(f"count(*) FILTER (event = '{c}') AS {c}" for c in inc.COUNTERS)
_RUN_SQL = f"""WITH ev AS (SELECT (dayofyear(ts))::BIGINT AS run_id, {_RUN_CASE} AS event FROM events), summary AS (SELECT *, CASE WHEN drift_errors > 0 THEN 'failed' WHEN failed_pages > 0 OR failed_details > 0 THEN 'partial' ELSE 'success' END AS status
  FROM (SELECT run_id, {_RUN_COUNTS} FROM ev GROUP BY 1))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _RUN_EVENTS.items()))
    return inc.run_summary(e.select(F.dayofyear("ts").cast("long").alias("run_id"), event.alias("event")))


@query("run_summary", f"{_RUN_SQL} SELECT * FROM summary")
def run_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("refresh_rule", f"{_RUN_SQL} SELECT run_id, new_items + changed_items + details_fetched + missing_items > 0 AS full_ FROM summary")
def refresh_rule(spark, sf_dir):
    summary = _summary(spark, sf_dir)
    return summary.select("run_id", inc.needs_full_refresh(summary).alias("full_"))


@query("close_runs", f"""{_RUN_SQL}, runs AS (SELECT dayofyear(ts)::BIGINT AS run_id, 'running' AS status, min(ts) AS started_at FROM events GROUP BY 1 UNION ALL SELECT dayofyear(ts)::BIGINT + 100, 'running', min(ts) FROM events GROUP BY 1)
SELECT r.run_id, CASE WHEN s.run_id IS NOT NULL THEN s.status WHEN r.run_id < max(r.run_id) OVER () THEN 'failed' ELSE r.status END AS status, started_at,
  CASE WHEN s.run_id IS NOT NULL OR r.run_id < max(r.run_id) OVER () THEN TIMESTAMP '{EVENTS_NOW}' END AS finished_at, CASE WHEN s.run_id IS NULL AND r.run_id < max(r.run_id) OVER () THEN 'abandoned' END AS error, {', '.join(f's.{c}' for c in inc.COUNTERS)}
FROM runs r LEFT JOIN summary s USING (run_id)""")
def close_runs(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").cast("long").alias("run_id")).agg(F.min("ts").alias("started_at"))
    runs = days.unionByName(days.withColumn("run_id", F.col("run_id") + 100)).select("run_id", F.lit("running").alias("status"), "started_at", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return inc.close_runs(runs, _summary(spark, sf_dir), EVENTS_NOW)


@query("stream_apply", f"""{_DETAILS}, gone AS (SELECT item_id, url FROM rich WHERE title LIKE '3-%') SELECT coalesce(r.item_id, d.item_id) AS item_id,
  CASE WHEN d.item_id IS NOT NULL THEN 'active' WHEN g.item_id IS NOT NULL THEN 'missing' ELSE r.status END AS status, CASE WHEN d.item_id IS NULL THEN r.view_count ELSE d.view_count END AS view_count,
  CASE WHEN d.item_id IS NOT NULL OR g.item_id IS NOT NULL THEN {_NOW} ELSE r.detail_fetched_at END AS detail_fetched_at FROM rich r FULL JOIN details d ON d.item_id = r.item_id LEFT JOIN gone g ON g.item_id = r.item_id""")
def stream_apply(spark, sf_dir):
    rich = b.rich_items(b.catalog(spark, sf_dir))
    ok = _details(rich).withColumn("outcome", F.lit("ok"))
    gone = rich.where("title like '3-%'").select("item_id", "url", F.lit("missing").alias("outcome"))
    outcomes = ok.unionByName(gone, allowMissingColumns=True).withColumn("seq", F.col("item_id"))
    ledger = spark.createDataFrame([], "entity_type string, entity_id string, operation string, url string, error_type string, error_message string, attempts int, last_failed_at timestamp_ntz, next_retry_at timestamp_ntz")
    return apply_outcomes(rich, ledger, outcomes, NOW)[0].select("item_id", "status", "view_count", "detail_fetched_at")


_STREAM_STEPS = 3


@query("stream_commits", f"""{_DETAILS}, gone AS (SELECT item_id, url FROM rich WHERE title LIKE '3-%'), state AS (SELECT coalesce(r.item_id, d.item_id) AS item_id,
  CASE WHEN d.item_id IS NOT NULL THEN 'active' WHEN g.item_id IS NOT NULL THEN 'missing' ELSE r.status END AS status, CASE WHEN d.item_id IS NULL THEN r.view_count ELSE d.view_count END AS view_count,
  CASE WHEN d.item_id IS NOT NULL OR g.item_id IS NOT NULL THEN {_NOW} ELSE r.detail_fetched_at END AS detail_fetched_at FROM rich r FULL JOIN details d ON d.item_id = r.item_id LEFT JOIN gone g ON g.item_id = r.item_id)
SELECT state.*, coalesce(u.n, 0)::INT AS attempts, {_STREAM_STEPS}::BIGINT AS runs FROM state LEFT JOIN (SELECT o_orderkey AS item_id, 1 AS n FROM orders WHERE o_orderpriority = '5-LOW') u USING (item_id)""")
def stream_commits(spark, sf_dir):
    """Outcomes as a stream of three micro-batches; the second is stopped between two writes, and the stream is started again."""
    rich = b.rich_items(b.catalog(spark, sf_dir))
    ok = _details(rich).withColumn("outcome", F.lit("ok"))
    gone = rich.where("title like '3-%'").select("item_id", "url", F.lit("missing").alias("outcome"))
    failed = rich.where("title like '5-LOW%'").select("item_id", "url", F.lit("error").alias("outcome"))
    outcomes = ok.unionByName(gone, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True).withColumn("seq", F.col("item_id"))
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    parts = stored(outcomes.withColumn("_step", F.pmod(F.xxhash64("item_id"), F.lit(_STREAM_STEPS))))
    for step in range(_STREAM_STEPS):
        parts.where(F.col("_step") == step).drop("_step").coalesce(1).write.mode("append").parquet(f"{root}/in")
    create_store(cm.CommitLog(spark, f"{root}/store"), rich, spark.createDataFrame([], FAILURES))
    source = lambda: spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def stop(epoch: int, step: str) -> None:
        if (epoch, step) == (1, "items"):
            raise RuntimeError("stopped between two writes")

    broken = apply.stream_commits(source(), f"{root}/store", f"{root}/checkpoint", NOW, between=stop)
    try:
        broken.awaitTermination()
    except StreamingQueryException:  # as asked for
        pass
    apply.stream_commits(source(), f"{root}/store", f"{root}/checkpoint", NOW).awaitTermination()
    log = cm.CommitLog(spark, f"{root}/store")
    head = log.head()
    attempts = log.read("ledger", head).select(F.col("entity_id").cast("long").alias("item_id"), "attempts")
    runs = log.read("runs", head).agg(F.count("*").alias("runs"))
    items = log.read("items", head).select("item_id", "status", "view_count", "detail_fetched_at").join(attempts, "item_id", "left").fillna(0, ["attempts"])
    return items.join(F.broadcast(runs))  # one row


# ---------------------------------------------------------------- monitoring


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.max("value") > 400, "failed").when(F.max("value") > 300, "partial").otherwise("success")
    return e.groupBy(F.dayofyear("ts").cast("long").alias("run_id")).agg(status.alias("status"), F.max("ts").alias("finished_at"))


_RUNS_SQL = "runs AS (SELECT dayofyear(ts)::BIGINT AS run_id, CASE WHEN max(value) > 400 THEN 'failed' WHEN max(value) > 300 THEN 'partial' ELSE 'success' END AS status, max(ts) AS finished_at FROM events GROUP BY 1)"


@query("dataset_status", f"{WITH}, {_RUNS_SQL} SELECT (SELECT count(*) FROM active) AS active_items, max(finished_at) FILTER (status IN ('success', 'partial')) AS last_good_at, max(run_id) AS last_run_id, max_by(status, run_id) AS last_status, max_by(finished_at, run_id) AS last_finished_at FROM runs")
def dataset_status(spark, sf_dir):
    return mon.dataset_status(b.catalog(spark, sf_dir).items, _runs(spark, sf_dir))


@query("data_version", f"WITH {_RUNS_SQL} SELECT max(run_id) || ':2024-02-01T00:00:00' AS version FROM runs")
def data_version(spark, sf_dir):
    return mon.data_version(_runs(spark, sf_dir), EVENTS_NOW)


@query("status_histogram", f"{LOG_SQL}, each AS (SELECT run_id, status, count(*) AS n FROM log GROUP BY 1, 2) SELECT run_id::VARCHAR AS run_id, '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS status_codes FROM each GROUP BY 1")
def status_histogram(spark, sf_dir):
    return mon.status_histogram(b.access_log(spark, sf_dir)).withColumn("run_id", F.col("run_id").cast("string"))


@query("access_counts", f"{LOG_SQL} SELECT method, route, status, count(*) AS n FROM log GROUP BY 1, 2, 3")
def access_counts(spark, sf_dir):
    return mon.access_counts(b.access_log(spark, sf_dir))


_LE = ", ".join(f"({x})" for x in mon.BUCKETS)
_HIST_SQL = f"{LOG_SQL}, le AS (SELECT le::DOUBLE AS le FROM (VALUES {_LE}, ('inf'::DOUBLE)) v(le)), hist AS (SELECT method, route, le, count(*) FILTER (duration <= le) AS n FROM log, le GROUP BY 1, 2, 3)"


@query("latency_histogram", f"{_HIST_SQL} SELECT method, route, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, n FROM hist")
def latency_histogram(spark, sf_dir):
    h = mon.latency_histogram(b.access_log(spark, sf_dir))
    return h.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query("latency_p95", f"""{_HIST_SQL}, steps AS (SELECT route, le, n, lag(le, 1, 0.0) OVER w AS low, lag(n, 1, 0) OVER w AS before, max(n) OVER (PARTITION BY route) AS total FROM hist WINDOW w AS (PARTITION BY route ORDER BY le))
SELECT route, round(min_by(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - before) / (n - before) END, le), 6) AS quantile FROM steps WHERE n >= 0.95::DOUBLE * total GROUP BY 1""")
def latency_p95(spark, sf_dir):
    q = mon.latency_quantile(mon.latency_histogram(b.access_log(spark, sf_dir)), 0.95, ("route",))
    return q.withColumn("quantile", F.round("quantile", 6))


@query("access_rollup", f"{LOG_SQL} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, method, route, count(*) AS requests, count(*) FILTER (status >= 500) AS errors, {', '.join(f'count(*) FILTER (duration <= {x}) AS le_{k}' for k, x in enumerate(mon.BUCKETS))} FROM log GROUP BY 1, 2, 3")
def rollup(spark, sf_dir):
    return access_rollup(b.access_log(spark, sf_dir))


@query("alerts", f"""{_HIST_SQL.replace('method, route, le, count', 'run_id, le, count').replace('GROUP BY 1, 2, 3', 'GROUP BY 1, 2')}, {_RUNS_SQL}, s AS (SELECT max(finished_at) FILTER (status IN ('success', 'partial')) AS good, max_by(status, run_id) AS last FROM runs),
t AS (SELECT count(*) FILTER (value > 450) AS throttled FROM events), steps AS (SELECT run_id, le, n, lag(le, 1, 0.0) OVER w AS low, lag(n, 1, 0) OVER w AS before, max(n) OVER (PARTITION BY run_id) AS total FROM hist WINDOW w AS (PARTITION BY run_id ORDER BY le)),
q AS (SELECT run_id, min_by(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - before) / (n - before) END, le) AS quantile FROM steps WHERE n >= 0.95::DOUBLE * total GROUP BY 1)
SELECT 'stale' AS alert, coalesce(date_diff('microsecond', good, TIMESTAMP '{EVENTS_NOW}') // 1000000 > 43200, true) AS firing FROM s UNION ALL SELECT 'last_run_failed', coalesce(last = 'failed', false) FROM s
UNION ALL SELECT 'throttled', throttled > 10 FROM t UNION ALL SELECT 'slow_pages', coalesce(min(quantile) > 0.5, false) FROM q""")
def alerts(spark, sf_dir):
    log = b.access_log(spark, sf_dir)
    status = mon.dataset_status(b.catalog(spark, sf_dir).items, _runs(spark, sf_dir))
    windows = mon.latency_quantile(mon.latency_histogram(log, ("route", "run_id")), 0.95, ("run_id",))
    throttled = table(spark, sf_dir, "events").agg(F.count_if(F.col("value") > 450).alias("throttled"))
    return mon.alerts(status, windows, throttled, EVENTS_NOW)


_STEPS_OF = lambda n: ", ".join(f"WHEN le_{k} >= 0.95::DOUBLE * {n} THEN {low}::DOUBLE + ({x}::DOUBLE - {low}::DOUBLE) * (0.95::DOUBLE * {n} - {f'le_{k - 1}' if k else 0}) / (le_{k} - {f'le_{k - 1}' if k else 0})" for k, (low, x) in enumerate(zip((0.0, *mon.BUCKETS), mon.BUCKETS))).replace(", WHEN", " WHEN")


@query("alert_stream", f"""{LOG_SQL}, mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS w FROM log),
rolled AS (SELECT route, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n, {', '.join(f'count(*) FILTER (duration <= {x}) AS le_{k}' for k, x in enumerate(mon.BUCKETS))} FROM log GROUP BY 1, 2),
c AS (SELECT route, s, n, CASE {_STEPS_OF('n')} ELSE {mon.BUCKETS[-1]} END AS quantile FROM rolled, mark WHERE s + INTERVAL 1 HOUR <= w),
g AS (SELECT *, s - row_number() OVER (PARTITION BY route ORDER BY s) * INTERVAL 1 HOUR AS g FROM c WHERE quantile > 0.2),
bad AS (SELECT route, s, n, quantile, CASE WHEN s - min(s) OVER (PARTITION BY route, g) >= INTERVAL 2 HOUR THEN 'firing' ELSE 'pending' END AS state FROM g),
late AS (SELECT route, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS late FROM log WHERE status = 500 AND ts < (SELECT min(ts) FROM log) + INTERVAL 1 DAY GROUP BY 1, 2),
states AS (SELECT * FROM bad UNION ALL SELECT c.*, CASE WHEN p.state = 'firing' THEN 'resolved' ELSE 'ok' END FROM c LEFT JOIN bad p ON p.route = c.route AND p.s = c.s - INTERVAL 1 HOUR WHERE NOT c.quantile > 0.2
UNION ALL SELECT p.route, p.s + INTERVAL 1 HOUR, 0, NULL, CASE WHEN p.state = 'firing' THEN 'resolved' ELSE 'ok' END FROM bad p, mark WHERE p.s + INTERVAL 2 HOUR <= w AND NOT EXISTS (SELECT 1 FROM c WHERE c.route = p.route AND c.s = p.s + INTERVAL 1 HOUR))
SELECT route, s AS window_start, n AS requests, round(quantile, 6) AS quantile, state, coalesce(late, 0) AS late FROM states LEFT JOIN late USING (route, s)""")
def alert_stream(spark, sf_dir):
    """Events in order as a stream in three runs, each going on where the last one stopped; the errors of the first day come once more with the third, too late."""
    log = b.access_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    ends = log.agg(F.percentile_approx(at, [1 / 3, 2 / 3], 1000).alias("cuts"), F.min("ts").cast("string").alias("first"), (F.max("ts") - F.expr("interval 10 minutes")).cast("string").alias("mark")).first()
    first, second = ends["cuts"] or (0, 0)
    again = log.where((F.col("status") == 500) & (F.col("ts") < F.lit(ends["first"]).cast("timestamp") + F.expr("interval 1 day")))
    root = f"{shared_root(spark)}/alerts-{uuid.uuid4().hex}"
    hour = timedelta(hours=1)
    for part in (log.where(at <= first), log.where((at > first) & (at <= second)), log.where(at > second).unionByName(again)):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        stream_alerts(source, f"{root}/out", f"{root}/checkpoint", window=hour, hold=2 * hour, limit=0.2).awaitTermination()
    states = spark.read.parquet(f"{root}/out")
    late = late_rows(spark.read.schema(log.schema).parquet(f"{root}/in"), states, ends["mark"] or "1970-01-01", hour)
    out = states.join(late, ["route", "window_start"], "left").fillna(0, ["late"])
    return out.select("route", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", F.round("quantile", 6).alias("quantile"), "state", "late")


# ---------------------------------------------------------------- extraction and clean-up


@query("extract_listings")
def extract_listings(spark, sf_dir):
    return hx.extract_listings(table(spark, sf_dir, "pages"), "https://example.com", ("example.com",))


@query("extract_details")
def extract_details(spark, sf_dir):
    d = hx.extract_details(table(spark, sf_dir, "pages"), "https://example.com", ("example.com", "example.net", "example.org"), ("example.net",))
    return d.select("item_id", "outcome", "title", F.size("tags").alias("n_tags"))


@query("page_outcomes")
def page_outcomes(spark, sf_dir):
    return hx.page_outcomes(table(spark, sf_dir, "pages"), "https://example.com", ("example.com",)).groupBy("listing", "detail").agg(F.count("*").alias("n"))


def _listing_pages(c: Catalog) -> DataFrame:
    """The catalogue's items as marked-up listing pages of up to 36."""
    escaped = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;"))
    number = lambda x: F.coalesce(F.format_number(x, 0), F.lit("-"))
    cell = F.concat(
        F.lit('<article><a class="box big" href="/movies/'), F.col("item_id").cast("string"), F.lit('?from=list"><span class="figure-text-in">'), number("view_count"), F.lit('</span><span class="figure-text-in">'),
        number("favorite_count"), F.lit('</span><h2 class="box-h2"> '), escaped(F.col("title")), F.lit('</h2><p class="box-text1"><b class="box-text-in">'), escaped(F.col("creator_display_name")), F.lit("</b></p></a></article>"),
    )
    pages = c.items.groupBy(F.floor(F.col("item_id") / 36).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("item_id", cell.alias("cell")))).alias("cells"))
    grid = F.concat(F.lit('<main><div class="g-main-grid">'), F.array_join("cells.cell", "<p>ad</p>"), F.lit('</div><ul class="pagination"><li><a class="page-link" href="/?page='), F.col("page_id").cast("string"), F.lit('">last</a></ul></main>'))
    return pages.select("page_id", grid.alias("html"))


@query("extract_rendered_listings", f"""{WITH} SELECT item_id // 36 AS page_id, (row_number() OVER (PARTITION BY item_id // 36 ORDER BY item_id) - 1)::INT AS pos, (item_id // 36)::INT AS last_page, item_id,
  'https://example.com/movies/' || item_id || '?from=list' AS url, title, creator_display_name AS creator_name, view_count, favorite_count FROM items""")
def extract_rendered_listings(spark, sf_dir):
    rows = hx.extract_listings(_listing_pages(b.catalog(spark, sf_dir)), "https://example.com", ("example.com",))
    return rows.select("page_id", "pos", "last_page", "item_id", "url", "title", "creator_name", "view_count", "favorite_count")


def _detail_pages(c: Catalog) -> DataFrame:
    """Every item as a marked-up detail page with its tags (each twice); missing items as placeholders, every hundredth without a title."""
    tags = c.links.where("kind = 'tags'").join(c.entities.where("kind = 'tags'").select("entity_id", "name"), "entity_id")
    anchor = lambda extra: F.concat(F.lit('<a href="/tags/'), F.col("entity_id").cast("string"), F.lit('"><i>local_offer</i> <em class="tag-text">local_offer '), F.col("name"), F.lit(f"{extra}</em></a>"))
    tags = tags.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", anchor("").alias("a"), anchor(" again").alias("b")))).alias("x"))
    rows = c.items.join(tags, "item_id", "left")
    counter = lambda icon, value: F.concat(F.lit(f'<li class="f-label-in"><i class="material-icons">{icon}</i><b class="video-text">'), value, F.lit("</b></li>"))
    head = F.when(F.col("item_id") % 100 == 0, "").otherwise(F.concat(F.lit('<h1 class="video-h1">'), "title", F.lit("</h1>")))
    day, clock = F.date_format("published_at", "yyyy-MM-dd"), F.date_format("published_at", "HH:mm")
    full = F.concat(
        F.lit("<body>"), head, F.lit('<ul class="video-views"><li><b class="video-text">'), day, F.lit('</b><b class="video-text">'), clock, F.lit("</b></li>"), counter("remove_red_eye", F.format_number("view_count", 0)),
        counter("favorite", F.coalesce(F.col("favorite_count").cast("string"), F.lit("-"))), F.lit('</ul><section class="video-section-tag">'), F.coalesce(F.array_join("x.a", ""), F.lit("")), F.coalesce(F.array_join("x.b", ""), F.lit("")), F.lit("</section>"),
    )
    gone = f'<title>{hx.PLACEHOLDER_TITLES[0]}</title><ul class="video-views"><b class="video-text">{hx.GONE_DATE}</b><b class="video-text">{hx.GONE_TIME}</b>'
    zero = F.concat(F.lit(gone), counter("remove_red_eye", F.lit("0")), counter("favorite", F.lit("0")), F.lit("</ul>"))
    return rows.select(F.col("item_id").alias("page_id"), F.concat(F.lit("https://example.com/movies/"), F.col("item_id").cast("string")).alias("url"), F.when(F.col("status") == "missing", zero).otherwise(full).alias("html"))


@query("extract_rendered_details", f"""{WITH}, tags AS (SELECT item_id, string_agg(entity_id || ':' || name, ',' ORDER BY entity_id) AS tags FROM links JOIN entities USING (kind, entity_id) WHERE kind = 'tags' GROUP BY 1)
SELECT item_id, CASE WHEN status = 'missing' THEN 'missing' WHEN item_id % 100 = 0 THEN 'drift' ELSE 'ok' END AS outcome, CASE WHEN status = 'missing' OR item_id % 100 = 0 THEN '' ELSE title END AS title,
  CASE WHEN status = 'missing' THEN '' ELSE coalesce(tags, '') END AS tags, CASE WHEN status = 'missing' THEN 0 ELSE view_count END AS view_count, CASE WHEN status = 'missing' THEN 0 ELSE favorite_count END AS favorite_count,
  CASE WHEN status <> 'missing' THEN date_trunc('minute', published_at)::TIMESTAMP END AS published_at FROM items LEFT JOIN tags USING (item_id)""")
def extract_rendered_details(spark, sf_dir):
    d = hx.extract_details(_detail_pages(b.catalog(spark, sf_dir)), "https://example.com", ("example.com",), ("example.net",))
    tags = F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["id"], x["name"])), ",")
    return d.select("item_id", "outcome", "title", tags.alias("tags"), "view_count", "favorite_count", "published_at")


@query("normalise_text", r"SELECT doc_id AS item_id, md5(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\s\x0B]+', ' ', 'g'))) AS clean FROM documents")
def normalise_text(spark, sf_dir):
    """All documents in wide letters with zero-width marks; what is clean again must be the cleaned document. Its SQL holds for tables
    without compatibility characters of their own, as the given ones; ``normalise_text_all`` has no such condition."""
    wide = F.translate("text", "aeiouAEIOU019 ", "ａｅｉｏｕＡＥＩＯＵ０１９\u3000")
    marked = F.regexp_replace(wide, "([tn])", "$1\u200b")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.md5(tx.clean_text(marked)).alias("clean"))


@query("normalise_text_all")
def normalise_text_all(spark, sf_dir):
    """``normalise_text`` over all documents; without SQL, as DuckDB lacks NFKC."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.md5(tx.clean_text(F.col("text"))).alias("clean"))


@query("normalise_numbers", """WITH raw AS (SELECT event_id, CASE event_type WHEN 'view' THEN value || 'k' WHEN 'click' THEN '1,' || user_id || '00' WHEN 'signup' THEN value || 'M' WHEN 'error' THEN 'none' ELSE user_id::VARCHAR END AS raw, value, user_id, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN floor(value * 1000.0::DOUBLE) WHEN 'click' THEN ('1' || user_id || '00')::DOUBLE WHEN 'signup' THEN floor(value * 1000000.0::DOUBLE) WHEN 'error' THEN NULL ELSE user_id END::BIGINT AS number FROM raw""")
def normalise_numbers(spark, sf_dir):
    kind, user, value = F.col("event_type"), F.col("user_id").cast("string"), F.col("value").cast("string")
    raw = F.when(kind == "view", F.concat(value, F.lit("k"))).when(kind == "click", F.concat(F.lit("1,"), user, F.lit("00"))).when(kind == "signup", F.concat(value, F.lit("M"))).when(kind == "error", "none").otherwise(user)
    return table(spark, sf_dir, "events").select("event_id", vl.parse_compact_number(raw).alias("number"))


@query("backfill_urls", """SELECT page_id AS item_id, CASE WHEN url LIKE 'https://%' AND regexp_matches(regexp_extract(url, '^https://([^/?#]*)', 1), '(^|\\.)example\\.(com|net)$') THEN url END AS url,
  NOT (url LIKE 'https://%' AND regexp_matches(regexp_extract(url, '^https://([^/?#]*)', 1), '(^|\\.)example\\.(com|net)$')) AS changed FROM pages""")
def backfill_urls(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), "url")
    return mg.backfill_urls(items, {"url": ("example.com", "example.net")})


@query("multiline_text", r"""WITH a AS (SELECT doc_id, replace(replace(coalesce(text, ''), '\', ''), '. ', '.' || repeat(chr(10), 4) || ' ') AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(t, '\r\n|[\r\x0B\x0C]', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)) AS t FROM a)
SELECT doc_id AS item_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS clean FROM b""")
def multiline_text(spark, sf_dir):
    """All documents with four stored line breaks after each sentence."""
    stored = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("")), F.lit(". "), F.lit(".\\n\\r\\n\\n\\n "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.md5(tx.clean_multiline(stored)).alias("clean"))


@query("cjk_tokens", f"""SELECT doc_id AS item_id, coalesce(regexp_matches(translate(substr(text, 1, 2), '{_LETTERS}', '{_SIGNS}'), '^[{_SIGNS}]+$'), false) AS is_cjk FROM documents""")
def cjk_tokens(spark, sf_dir):
    head = F.translate(F.substring("text", 1, 2), _LETTERS, _SIGNS)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce(tx.is_cjk(head), F.lit(False)).alias("is_cjk"))


@query("links_and_ids", """WITH l AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/movies/' || page_id WHEN 1 THEN '//cdn.example.com/tags/' || page_id WHEN 2 THEN 'authors/' || page_id WHEN 3 THEN url END AS link, url FROM pages),
a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://example.com' || link WHEN 1 THEN 'https:' || link WHEN 2 THEN 'https://example.com/' || link WHEN 3 THEN CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN url END END AS url FROM l)
SELECT page_id AS item_id, a.url, CASE page_id % 5 WHEN 0 THEN page_id END AS item, CASE WHEN page_id % 5 IN (1, 2) THEN page_id END AS entity FROM a WHERE page_id % 5 <> 3 OR a.url IS NOT NULL""")
def links_and_ids(spark, sf_dir):
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    link = F.when(kind == 0, F.concat(F.lit("/movies/"), n)).when(kind == 1, F.concat(F.lit("//cdn.example.com/tags/"), n)).when(kind == 2, F.concat(F.lit("authors/"), n)).when(kind == 3, F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", vl.absolute_url(link, "https://example.com").alias("url"))
    return rows.select(F.col("page_id").alias("item_id"), "url", vl.item_id_of(F.col("url")).alias("item"), vl.entity_id_of(F.col("url")).alias("entity"))


@query("backfill_comments", f"{RICH_SQL} SELECT item_id, replace(comment, '\\n', chr(10)) AS comment FROM rich")
def backfill_comments(spark, sf_dir):
    return mg.backfill_comments(b.rich_items(b.catalog(spark, sf_dir)).select("item_id", "comment"))


@query("highlight", f"{WITH} SELECT item_id, regexp_replace(title, '(urgent|machinery|build)', '<mark>\\1</mark>', 'gi') AS marked FROM items")
def highlight(spark, sf_dir):
    return b.catalog(spark, sf_dir).items.select("item_id", tx.highlight(F.col("title"), ["build", "Urgent", "machinery"]).alias("marked"))


@query("highlight_markup", f"""{WITH} SELECT item_id, regexp_replace(replace(replace(replace('<' || title || '> & "' || item_id || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;').replace('"', '&#34;'), '(urgent|machinery|build)', '<mark>\\1</mark>', 'gi') AS marked FROM items""")
def highlight_markup(spark, sf_dir):
    text = F.concat(F.lit("<"), "title", F.lit('> & "'), F.col("item_id").cast("string"), F.lit('"'))
    return b.catalog(spark, sf_dir).items.select("item_id", tx.highlight(text, ["build", "Urgent", "machinery"]).alias("marked"))


@query("compact_numbers_east", f"""{WITH} SELECT item_id, CASE WHEN v >= 100000000 THEN regexp_replace(printf('%.1f', v / 100000000.0::DOUBLE), '\\.0$', '') || '億' WHEN v >= 10000 THEN regexp_replace(printf('%.1f', v / 10000.0::DOUBLE), '\\.0$', '') || '万'
  ELSE format('{{:,}}', v) END AS compact FROM (SELECT item_id, view_count * (item_id % 3 * 700 + 1) AS v FROM items)""")
def compact_numbers_east(spark, sf_dir):
    v = F.col("view_count") * (F.col("item_id") % 3 * 700 + 1)
    return b.catalog(spark, sf_dir).items.select("item_id", vl.format_compact(v, "ja").alias("compact"))


_TO = {0: "あ", 1: "한", 2: "漢"}  # kana, hangul or neither for one letter


@query("content_language", f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 {' '.join(f"WHEN {k} THEN translate(text, 'q', '{v}')" for k, v in _TO.items())} END AS text FROM documents)
SELECT doc_id AS item_id, CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'ko' END AS language FROM t""")
def content_language(spark, sf_dir):
    text = F.coalesce(*(F.when(F.col("doc_id") % 3 == k, F.translate("text", "q", v)) for k, v in _TO.items()))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), tx.content_language(text).alias("language"))


@query("compact_numbers", f"""{WITH} SELECT item_id, CASE WHEN view_count >= 1000000 THEN regexp_replace(printf('%.1f', view_count / 1000000.0::DOUBLE), '\\.?0+$', '') || 'M' WHEN view_count >= 1000 THEN regexp_replace(printf('%.1f', view_count / 1000.0::DOUBLE), '\\.?0+$', '') || 'K'
  ELSE view_count::VARCHAR END AS compact, format('{{:,}}', view_count) AS full_, greatest(1, ceil(view_count / 36.0::DOUBLE))::BIGINT AS pages FROM items""")
def compact_numbers(spark, sf_dir):
    v = F.col("view_count")
    return b.catalog(spark, sf_dir).items.select("item_id", vl.format_compact(v).alias("compact"), vl.format_count(v).alias("full_"), vl.page_count(v, 36).alias("pages"))


@query("timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00+09:00') AS iso, strftime(ts, '%Y-%m-%d %H:%M UTC') AS shown FROM events")
def timestamps(spark, sf_dir):
    stored = F.date_format("ts", "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", vl.iso_datetime(vl.parse_published(stored)).alias("iso"), vl.format_timestamp(F.col("ts")).alias("shown"))


@query("relative_time", """WITH t AS (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 1e6::DOUBLE AS s FROM events), m AS (SELECT *, floor(s / 60)::BIGINT AS m FROM t)
SELECT event_id, CASE WHEN s < 0 OR m // 1440 >= 30 THEN 'date' WHEN m < 1 THEN 'just_now' WHEN m < 60 THEN 'minutes' WHEN m < 1440 THEN 'hours' ELSE 'days' END AS unit,
  CASE WHEN s < 0 OR m // 1440 >= 30 OR m < 1 THEN NULL WHEN m < 60 THEN m WHEN m < 1440 THEN m // 60 ELSE m // 1440 END AS count FROM m""")
def relative_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", vl.relative_time(F.col("ts"), ntz("2024-01-20 00:00:00")).alias("x")).select("event_id", "x.unit", "x.count")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
