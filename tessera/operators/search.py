"""Search pages, cards, details, links, and search for many requests at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, fold_words
from ..functions.workers import stored
from ..schema import COUNTS, Catalog, SearchRequest
from .filters import LONG, MAX_TOKENS, active, apply_filters

#: Up to so many distinct postings (short strings) of a batch's tokens are broadcast.
FEW_POSTINGS = 100_000
#: Up to so many are pushed down to the scan of the postings.
PUSHED_POSTINGS = 200
#: mode: columns of the order; equal rows are told apart by item_id
SORTS = {
    "published_desc": ("-published_at", "-item_id"),
    "published_asc": ("published_at", "item_id"),
    "favorites_desc": ("-favorite_count", "-published_at", "-item_id"),
    "favorites_asc": ("favorite_count", "published_at", "item_id"),
    "views_desc": ("-view_count", "-published_at", "-item_id"),
    "views_asc": ("view_count", "published_at", "item_id"),
    "popularity_desc": ("-popularity", "-item_id"),
    "hot_desc": ("-hot_score", "-item_id"),
}


def sort_columns(mode: str) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_first() for c in SORTS[mode]]


@dataclass
class SearchPage:
    items: DataFrame
    total: int
    capped: bool
    page: int
    page_count: int


def capped_count(found: DataFrame, cap: int, page_size: int = 36) -> DataFrame:
    """(total, is_capped, page_count) in one row; counting stops beyond the cap."""
    n = found.limit(cap + 1).agg(F.count("*").alias("n"))
    total = F.least("n", F.lit(cap))
    return n.select(total.alias("total"), (F.col("n") > cap).alias("is_capped"), F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long").alias("page_count"))


def search(catalog: Catalog, request: SearchRequest, page: int = 1, page_size: int = 36, max_results: int = 10_000, docs: DataFrame | None = None) -> SearchPage:
    """One page; the total is capped and the page clamped to the capped page count."""
    found = apply_filters(catalog, request, docs)
    total, is_capped, pages = capped_count(found, max_results, page_size).first()
    page = min(max(page, 1), pages)
    return SearchPage(found.orderBy(*sort_columns(request.order)).offset((page - 1) * page_size).limit(page_size), total, is_capped, page, pages)


def cards(catalog: Catalog) -> DataFrame:
    creators = catalog.entities.where("kind = 'authors'").select(F.col("entity_id").alias("creator_id"), F.col("name").alias("_name"))
    return catalog.items.join(creators, "creator_id", "left").select(
        "item_id", "title", "creator_id", F.coalesce("_name", "creator_display_name", F.lit("")).alias("creator_name"), "published_at",
        F.coalesce("view_count", F.lit(0)).alias("view_count"), F.coalesce("favorite_count", F.lit(0)).alias("favorite_count"), "status",
    )


def item_links(catalog: Catalog, kind: str) -> DataFrame:
    """(item_id, links): ids and names of an item's entities, by name."""
    named = catalog.links.where(F.col("kind") == kind).join(catalog.entities.where(F.col("kind") == kind).select("entity_id", "name"), "entity_id")
    return named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("name", "entity_id"))).alias("links"))


def item_details(catalog: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Cards with the links of tags, origins and characters, of all items or of those in ``ids``."""
    if ids is not None:
        keep = ids.select("item_id").distinct()
        catalog = Catalog(catalog.items.join(keep, "item_id", "left_semi"), catalog.entities, catalog.links.join(keep, "item_id", "left_semi"))
    named = catalog.links.where("kind <> 'authors'").join(catalog.entities.select("kind", "entity_id", "name"), ["kind", "entity_id"])
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "entity_id")))).alias(kind)
    links = named.groupBy("item_id").agg(of("tags"), of("origins"), of("characters"))
    out = cards(catalog).join(links, "item_id", "left")
    empty = F.array().cast("array<struct<name:string,entity_id:bigint>>")
    return out.withColumns({k: F.coalesce(k, empty) for k in ("tags", "origins", "characters")})


def resolve_entities(catalog: Catalog, wanted: DataFrame) -> DataFrame:
    """(pos, entity_id, name) for ``wanted`` (pos, kind, entity_id); unknown ids drop out, ``pos`` keeps the order."""
    return wanted.join(catalog.entities.select("kind", "entity_id", "name"), ["kind", "entity_id"]).select("pos", "kind", "entity_id", "name")


def _trigrams(c: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(LONG)))


def postings(docs: DataFrame) -> DataFrame:
    """(posting, item_id) of search documents: trigrams (t:), CJK grams (c:), beginnings of words of one and two characters (p:)."""
    mark = lambda kind, grams: F.transform(grams, lambda g: F.concat(F.lit(f"{kind}:"), g))
    heads = F.flatten(F.transform("words", lambda w: F.array(F.substring(w, 1, 1), F.substring(w, 1, 2))))
    grams = F.concat(mark("t", F.concat(_trigrams("title_folded"), _trigrams("keywords_folded"))), mark("c", F.col("grams")), mark("p", heads))
    return docs.select("item_id", F.explode(F.array_distinct(grams)).alias("posting"))


def token_postings(tokens: DataFrame) -> DataFrame:
    """(token, low, verify, posting): all postings that an item with the token has; ``verify`` if texts must be looked at besides."""
    low = F.lower("token")
    flat = F.filter(F.split(fold_words(F.col("token")), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")
    tokens = tokens.select("token", low.alias("low"), F.try_element_at(flat, F.lit(1)).alias("head"), F.col("token").rlike(f"^[{CJK}]+$").alias("cjk"))
    long = F.length("token") >= LONG
    keys = (
        F.when(long, F.transform(_trigrams("low"), lambda g: F.concat(F.lit("t:"), g)))
        .when(F.col("cjk"), F.array(F.concat(F.lit("c:"), "token")))
        .when(F.col("head").isNotNull(), F.array(F.concat(F.lit("p:"), "head")))
    )
    return tokens.select("token", "low", long.alias("verify"), F.explode(F.array_distinct(keys)).alias("posting"))


def token_hits(tokens: DataFrame, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(token, item_id) for distinct ``tokens`` (token), each by the rarest of its postings; ids only are joined until texts verify them."""
    wanted = token_postings(tokens)
    asked = wanted.select("posting").distinct()
    index = postings(docs) if index is None else index
    names = [r["posting"] for r in asked.limit(PUSHED_POSTINGS + 1).collect()]
    if 0 < len(names) <= PUSHED_POSTINGS:  # equalities reach the scan, which skips pages of a sorted index
        index = index.where(reduce(lambda a, b: a | b, (F.col("posting") == n for n in names)))
    else:
        index = index.join(F.broadcast(asked) if asked.count() <= FEW_POSTINGS else asked, "posting", "left_semi")
    sizes = wanted.join(index.groupBy("posting").agg(F.count("*").alias("n")), "posting", "left").fillna(0, ["n"])
    rarest = sizes.groupBy("token", "low", "verify").agg(F.min_by("posting", F.struct("n", "posting")).alias("posting"))
    met = rarest.join(index, "posting").select("token", "low", "verify", "item_id")
    texts = docs.select("item_id", "title_folded", "keywords_folded")
    checked = met.where("verify").join(texts, "item_id").where(F.contains("title_folded", F.col("low")) | F.contains("keywords_folded", F.col("low")))
    return checked.select("token", "item_id").unionByName(met.where("not verify").select("token", "item_id"))


def search_batch(catalog: Catalog, requests: DataFrame, docs: DataFrame | None = None, index: DataFrame | None = None, hits_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, item_id) for ``requests``: query_id, tokens (array), title_mode, facets (array of kind, mode, ids) and, if there,
    published_from, published_to, min_views, max_views, min_favorites, max_favorites.

    Equal conditions of many requests are one condition, whose items are found once: a set of tokens through ``token_hits``, a facet through
    links by id. ``hits_of`` gives (token, item_id) for a table of tokens, such as ``SegmentIndex.hits``; without it ``docs`` are searched. A request begins with the condition that fewest items meet and looks its other conditions up by (condition, item);
    ranges and barred facets come last. A request without text and positive facets begins with all active items.
    """
    requests = stored(requests)  # read by every branch below
    hits_of = hits_of or (lambda t: token_hits(t, docs, index))
    ids = F.array_sort(F.array_distinct("x.ids"))
    facets = requests.select("query_id", F.explode("facets").alias("x")).where(F.size("x.ids") > 0).select("query_id", F.xxhash64("x.kind", "x.mode", ids).alias("cond"), "x.kind", "x.mode", ids.alias("ids"))
    tokens = F.slice(F.array_distinct("tokens"), 1, MAX_TOKENS)
    texts = requests.select("query_id", F.xxhash64(F.array_sort(tokens), "title_mode").alias("cond"), tokens.alias("tokens"), "title_mode").where(F.size("tokens") > 0)
    # items of every distinct condition
    each_facet = facets.dropDuplicates(["cond"]).select("cond", "kind", "mode", F.size("ids").alias("n_ids"), F.explode("ids").alias("entity_id"))
    linked = each_facet.join(catalog.links, ["kind", "entity_id"]).groupBy("cond", "item_id", "mode", "n_ids").agg(F.countDistinct("entity_id").alias("n")).where("mode <> 'all' or n = n_ids").select("cond", "item_id")
    each_text = texts.dropDuplicates(["cond"]).select("cond", "title_mode", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    worded = each_text.join(hits_of(each_text.select("token").distinct()), "token").groupBy("cond", "item_id", "title_mode", "n_tokens").agg(F.count("*").alias("n")).where("title_mode = 'any' or n = n_tokens").select("cond", "item_id")
    everything = F.lit(0).cast("long").alias("cond")
    positive = facets.where("mode <> 'not'").select("query_id", "cond").unionByName(texts.select("query_id", "cond")).distinct()
    open_ = requests.select("query_id").join(positive, "query_id", "left_anti").select("query_id", everything)
    needed = positive.unionByName(open_)
    hits = stored(linked.unionByName(worded))
    barred = facets.where("mode = 'not'").select("query_id", "cond").join(hits, "cond").select("query_id", "item_id").distinct()
    if not open_.isEmpty():
        hits = hits.unionByName(active(catalog.items).select(everything, "item_id"))
    sizes = hits.groupBy("cond").agg(F.count("*").alias("size"))
    ordered = needed.join(sizes, "cond", "left").groupBy("query_id").agg(F.min_by("cond", F.struct(F.coalesce("size", F.lit(0)), "cond")).alias("first"), F.collect_set("cond").alias("all"))
    ordered = ordered.select("query_id", "first", F.array_except("all", F.array("first")).alias("rest"))
    found = ordered.join(hits.withColumnRenamed("cond", "first"), "first").select("query_id", "item_id", "rest")
    more = found.where(F.size("rest") > 0).select("query_id", "item_id", F.size("rest").alias("due"), F.explode("rest").alias("cond"))
    more = more.join(hits, ["cond", "item_id"]).groupBy("query_id", "item_id", "due").agg(F.count("*").alias("n")).where("n = due").select("query_id", "item_id")
    found = found.where(F.size("rest") == 0).select("query_id", "item_id").unionByName(more)
    found = found.join(barred, ["query_id", "item_id"], "left_anti")
    return _in_range(active(catalog.items), found, requests)


def _in_range(items: DataFrame, found: DataFrame, requests: DataFrame) -> DataFrame:
    have = set(requests.columns)
    fits, columns = F.lit(True), ["item_id"]
    for side, at, far in (("published_from", lambda d: F.col("published_at") >= d, 0), ("published_to", lambda d: F.col("published_at") < d, 1)):
        if side in have:
            day = F.date_add(F.try_to_date(F.col(side), "yyyy-MM-dd"), far).cast("timestamp_ntz")
            fits = fits & (F.coalesce(F.col(side), F.lit("")).eqNullSafe("") | F.coalesce(at(day), F.lit(False)))
            columns.append("published_at")
    for name, column in COUNTS.items():
        count = F.coalesce(column, F.lit(0))
        for side, holds in ((f"min_{name}", count >= F.col(f"min_{name}")), (f"max_{name}", count <= F.col(f"max_{name}"))):
            if side in have:
                fits = fits & F.coalesce(holds, F.lit(True))
                columns.append(column)
    bounds = [c for c in ("published_from", "published_to", *(f"{s}_{n}" for n in COUNTS for s in ("min", "max"))) if c in have]
    found = found.join(items.select(*dict.fromkeys(columns)), "item_id")
    return (found.join(requests.select("query_id", *bounds), "query_id") if bounds else found).where(fits).select("query_id", "item_id")


def batch_pages(catalog: Catalog, found: DataFrame, requests: DataFrame, page_size: int = 36) -> DataFrame:
    """(query_id, rank, item_id): the first page of every request of ``search_batch`` in its own order (column ``sort``); items have scores."""
    keys = {"published": F.unix_micros(F.col("published_at").cast("timestamp")).cast("double"), "hot": F.col("hot_score"), "popularity": F.col("popularity").cast("double")}
    keys |= {name: F.col(c).cast("double") for name, c in COUNTS.items()}
    name, rising = F.split_part("sort", F.lit("_"), F.lit(1)), F.col("sort").endswith("_asc")
    value = F.coalesce(*(F.when(name == k, c) for k, c in keys.items()))
    signed = lambda c: F.when(rising, -c).otherwise(c)
    empty = lambda c: F.when(c.isNull(), rising).otherwise(~rising)  # noqa: E731  nulls first in rising orders
    second = F.when(name.isin(*COUNTS), keys["published"])
    order = [empty(value).desc(), signed(value).desc(), F.when(name.isin(*COUNTS), empty(second)).desc(), signed(second).desc(), signed(F.col("item_id")).desc()]
    columns = dict.fromkeys(["item_id", "published_at", "hot_score", "popularity", *COUNTS.values()])
    rows = found.join(catalog.items.select(*columns), "item_id").join(requests.select("query_id", "sort"), "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= page_size).select("query_id", "rank", "item_id")
