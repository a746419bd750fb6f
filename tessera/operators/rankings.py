"""Entity statistics, rankings, leaderboards and autocomplete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Catalog
from .filters import active
from .scoring import with_scores

CATEGORIES = ("tags", "origins")
#: Names of a gram that a task gets, about.
SHARE = 20_000
#: Up to so many grams (three characters at most) of a batch of queries are broadcast.
FEW_GRAMS = 200_000


def entity_stats(catalog: Catalog, as_of) -> DataFrame:
    """Counts and sums over the active items of every entity that has one; one aggregation for all kinds."""
    items = with_scores(active(catalog.items), as_of).select("item_id", "view_count", "favorite_count", "popularity", "hot_score")
    per_entity = catalog.links.join(items, "item_id").groupBy("kind", "entity_id").agg(
        F.count("*").alias("item_count"),
        F.coalesce(F.sum("view_count"), F.lit(0)).alias("total_views"),
        F.coalesce(F.sum("favorite_count"), F.lit(0)).alias("total_favorites"),
        F.coalesce(F.sum("popularity"), F.lit(0)).alias("popularity"),
        F.coalesce(F.sum("hot_score"), F.lit(0.0)).alias("hot"),
    )
    return per_entity.join(catalog.entities.select("kind", "entity_id", "name"), ["kind", "entity_id"]).select(
        "kind", "entity_id", "name", "item_count", "total_views", "total_favorites", "popularity", "hot"
    )


MEASURES = ("item_count", "total_views", "total_favorites", "popularity", "hot")


def entity_changes(before: Catalog, after: Catalog, touched: DataFrame, as_of) -> DataFrame:
    """What the ``touched`` items (item_id) add to every entity's statistics: their new rows count, their old ones are taken back. Only their links are read."""
    ids = touched.select("item_id").distinct()

    def signed(catalog: Catalog, sign: int) -> DataFrame:
        items = with_scores(active(catalog.items.join(ids, "item_id", "left_semi")), as_of)
        links = catalog.links.join(ids, "item_id", "left_semi")
        values = {"item_count": F.lit(1), "total_views": F.col("view_count"), "total_favorites": F.col("favorite_count"), "popularity": F.col("popularity"), "hot": F.col("hot_score")}
        return links.join(items, "item_id").select("kind", "entity_id", *((F.coalesce(c, F.lit(0)) * sign).alias(n) for n, c in values.items()))

    return signed(after, 1).unionByName(signed(before, -1)).groupBy("kind", "entity_id").agg(*(F.sum(c).alias(c) for c in MEASURES))


def updated_stats(stats: DataFrame, changes: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_stats`` after ``entity_changes``, whose scores are of the same moment: sums are added, entities without active items leave."""
    key = ["kind", "entity_id"]
    named = changes.join(entities.select(*key, "name"), key)
    both = stats.alias("o").join(named.alias("c"), key, "full_outer")
    sums = {m: F.coalesce(f"o.{m}", F.lit(0)) + F.coalesce(f"c.{m}", F.lit(0)) for m in MEASURES}
    return both.select(*key, F.coalesce("c.name", "o.name").alias("name"), *(v.alias(m) for m, v in sums.items())).where("item_count > 0")


def kinds_of(board: str) -> tuple[str, ...]:
    return CATEGORIES if board == "categories" else (board,)


RANK_ORDER = ("popularity", "total_favorites", "item_count")


def rank_order() -> list:
    return [*(F.col(c).desc() for c in RANK_ORDER), F.col("name"), F.col("kind"), F.col("entity_id")]


def ranking(stats: DataFrame, board: str, limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of a board with absolute ranks and the mark of the first three."""
    page = stats.where(F.col("kind").isin(*kinds_of(board))).orderBy(*rank_order()).offset(offset).limit(limit)
    rank = (F.row_number().over(Window.orderBy(*rank_order())) + offset).cast("int")  # over one page
    return page.withColumn("rank", rank).withColumn("is_top", F.col("rank") <= 3)


def ranking_counts(stats: DataFrame) -> DataFrame:
    """Ranked entities of every board, ``categories`` included."""
    boards = F.when(F.col("kind").isin(*CATEGORIES), F.array("kind", F.lit("categories"))).otherwise(F.array("kind"))
    return stats.select(F.explode(boards).alias("board")).groupBy("board").agg(F.count("*").alias("n"))


def leaderboards(stats: DataFrame, limit: int = 12) -> DataFrame:
    """The first entities of characters, authors and categories in one result."""
    board = F.when(F.col("kind").isin(*CATEGORIES), "categories").otherwise(F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("board").orderBy(*rank_order()))
    return stats.withColumn("board", board).withColumn("rank", rank).where(F.col("rank") <= limit)


def rank_share(page: DataFrame) -> DataFrame:
    """Popularity relative to the page's largest."""
    largest = F.greatest(F.max("popularity").over(Window.partitionBy()), F.lit(1))
    return page.withColumn("share", F.col("popularity") / largest)


def top_items_per_creator(catalog: Catalog, creators: DataFrame | None = None, n: int = 8) -> DataFrame:
    items = active(catalog.items).where("creator_id is not null")
    if creators is not None:
        items = items.join(creators.select("creator_id").distinct(), "creator_id", "left_semi")
    popularity = F.coalesce("view_count", F.lit(0)) + F.coalesce("favorite_count", F.lit(0)) * 50
    items = items.withColumn("popularity", popularity)
    rank = F.row_number().over(Window.partitionBy("creator_id").orderBy(F.col("popularity").desc(), F.col("item_id").desc()))
    return items.withColumn("rank", rank).where(F.col("rank") <= n).select("creator_id", "rank", "item_id", "popularity")


def autocomplete(catalog: Catalog, stats: DataFrame, kind: str, query: str = "", limit: int = 10) -> DataFrame:
    """Names that contain the query, those that begin with it first; without a query the most popular."""
    needle = query.strip().lower()
    scores = stats.where(F.col("kind") == kind).select("entity_id", "popularity", F.col("name").alias("_name"))
    if not needle:
        return scores.orderBy(F.col("popularity").desc(), "_name", "entity_id").limit(limit).select("entity_id", F.col("_name").alias("name"))
    names = catalog.entities.where((F.col("kind") == kind) & F.contains(F.lower("name"), F.lit(needle))).select("entity_id", "name")
    found = names.join(scores.drop("_name"), "entity_id", "left")
    return found.orderBy(F.lower("name").startswith(needle).desc(), F.coalesce("popularity", F.lit(0)).desc(), "name", "entity_id").limit(limit).select("entity_id", "name")


def _grams(text: str, sizes: tuple[int, ...]) -> Column:
    """All distinct runs of so many characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    run = lambda n: F.transform(at, lambda i: F.substr(F.col(text), i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*map(run, sizes))))


def autocomplete_batch(catalog: Catalog, stats: DataFrame, kind: str, queries: DataFrame, limit: int = 10, share: int = SHARE) -> DataFrame:
    """Autocomplete for many ``queries`` (query).

    A query of one or two characters meets the names that have it, a longer one those that have the rarest of its trigrams. The names of a
    gram are dealt in shares of about ``share`` names, so one that very many names have (a common prefix) is no task of its own; each
    task keeps the first names of a query before they are ranked.
    """
    queries = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    asked = queries.select("query", F.explode(F.when(F.length("query") < 3, F.array("query")).otherwise(F.filter(_grams("query", (3,)), lambda g: F.length(g) == 3))).alias("gram"))
    names = catalog.entities.where(F.col("kind") == kind).select("entity_id", "name", F.lower("name").alias("_low"))
    wanted = asked.select("gram").distinct()
    held = names.withColumn("gram", F.explode(_grams("_low", (1, 2, 3)))).join(F.broadcast(wanted) if wanted.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS else wanted, "gram", "left_semi")
    sizes = held.groupBy("gram").agg(F.count("*").alias("n"))
    best = asked.join(sizes, "gram").groupBy("query").agg(F.min(F.struct("n", "gram")).alias("x"), F.count("*").alias("met"))
    due = asked.groupBy("query").agg(F.count("*").alias("due"))
    best = best.join(due, "query").where("met = due")  # a gram that no name has
    best = best.select("query", "x.gram", F.ceil(F.col("x.n") / share).cast("int").alias("shares"))
    dealt = best.select("query", "gram", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"))
    parts = best.select("gram", "shares").distinct()
    placed = held.join(parts, "gram").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("shares")).cast("int")).drop("shares")
    met = placed.join(dealt, ["gram", "part"]).where(F.contains("_low", F.col("query")))
    scores = stats.where(F.col("kind") == kind).select("entity_id", "popularity")
    met = met.join(scores, "entity_id", "left").select("query", "entity_id", "name", F.startswith("_low", "query").alias("_first"), F.coalesce("popularity", F.lit(0)).alias("popularity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("_first").desc(), F.col("popularity").desc(), "name", "entity_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "entity_id", "name")
