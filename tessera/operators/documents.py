"""Search documents: a title and every name attached to an item, in folded and tokenised forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_grams, words
from ..schema import Catalog


def search_document(catalog: Catalog) -> DataFrame:
    """(item_id, title, keywords): creator, characters, origins and tags; names in order within a kind."""
    named = catalog.links.where("kind <> 'authors'").join(catalog.entities.select("kind", "entity_id", "name"), ["kind", "entity_id"])
    of = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))), " ").alias(kind)
    names = named.groupBy("item_id").agg(of("characters"), of("origins"), of("tags"))
    creators = catalog.entities.where("kind = 'authors'").select(F.col("entity_id").alias("creator_id"), F.col("name").alias("_creator"))
    keywords = F.trim(F.concat(
        F.coalesce("_creator", "creator_display_name", F.lit("")), F.lit(" "),
        *(x for k in ("characters", "origins", "tags") for x in (F.coalesce(k, F.lit("")), F.lit(" "))),
    ))
    items = catalog.items.select("item_id", "title", "creator_id", "creator_display_name")
    return items.join(creators, "creator_id", "left").join(names, "item_id", "left").select("item_id", "title", keywords.alias("keywords"))


def short_terms(docs: DataFrame) -> DataFrame:
    """Adds grams (CJK) and words of title and keywords."""
    text = F.concat_ws(" ", "title", "keywords")
    return docs.withColumn("grams", cjk_grams(text)).withColumn("words", words(text))


def build_search_docs(catalog: Catalog, item_ids: DataFrame | None = None) -> DataFrame:
    """The documents that the text predicates search, of all items or of those in ``item_ids``."""
    if item_ids is not None:
        touched = item_ids.select("item_id").distinct()
        catalog = Catalog(catalog.items.join(touched, "item_id", "left_semi"), catalog.entities, catalog.links.join(touched, "item_id", "left_semi"))
    docs = search_document(catalog)
    folded = docs.withColumn("title_folded", F.lower(F.coalesce("title", F.lit("")))).withColumn("keywords_folded", F.lower("keywords"))
    return short_terms(folded)
