"""Boolean faceted search: the predicates and their composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from ..schema import Catalog, SearchRequest

MAX_TOKENS = 8
LONG = 3


def active(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "active")


def facet(items: DataFrame, links: DataFrame, kind: str, mode: str, ids: list[int]) -> DataFrame:
    """Items linked to any, to none or to all of ``ids``; ids are pushed down to the scan of links."""
    ids = list(dict.fromkeys(ids))
    if not ids:
        return items
    hits = links.where((F.col("kind") == kind) & F.col("entity_id").isin(ids)).select("item_id", "entity_id")
    if mode == "all":
        hits = hits.groupBy("item_id").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") == len(ids))
    return items.join(hits.select("item_id"), "item_id", "left_anti" if mode == "not" else "left_semi")


def date_range(items: DataFrame, first: str = "", last: str = "") -> DataFrame:
    """Both days inclusive; items without a date drop out of any bounded search."""
    if first:
        items = items.where(F.col("published_at") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        items = items.where(F.col("published_at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return items


def count_range(items: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    count = F.coalesce(column, F.lit(0))
    if low is not None:
        items = items.where(count >= low)
    if high is not None:
        items = items.where(count <= high)
    return items


def token_matches(token: str) -> Column:
    """Whether a search document (``build_search_docs``) has a token.

    Three characters and more: substring of title or keywords, whatever its case. One or two CJK characters: a gram.
    Other short tokens: the beginning of a word, without case and diacritics; one without letters and digits matches nothing.
    """
    import re
    import unicodedata

    if len(token) >= LONG:
        folded = token.lower()
        return F.contains("title_folded", F.lit(folded)) | F.contains("keywords_folded", F.lit(folded))
    if re.fullmatch(f"[{CJK}]+", token):
        return F.array_contains("grams", token)
    flat = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    parts = [p for p in re.split(r"[\W_]+", flat) if p]
    return F.exists("words", lambda w: w.startswith(parts[0])) if parts else F.lit(False)


def query_tokens(q: str) -> list[str]:
    import re
    import unicodedata

    flat = unicodedata.normalize("NFKC", q or "").replace("\u200b", "").replace("\ufeff", "")
    return [t for t in re.split("[\\s,\uff0c\u3001]+", flat) if t][:MAX_TOKENS]


def text_predicate(q: str, mode: str = "all") -> Column | None:
    parts = [token_matches(t) for t in query_tokens(q)]
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), parts) if parts else None


def name_contains(names: DataFrame, needle: str) -> DataFrame:
    return names.where(F.contains(F.lower("name"), F.lit(needle.strip().lower())))


def lookup(items: DataFrame, ids: list[int]) -> DataFrame:
    return items.where(F.col("item_id").isin(list(ids)))


def any_seen_since(pages: DataFrame, items: DataFrame, since) -> DataFrame:
    """Pages (page, item_id) with ``overlaps``: whether any of a page's items was seen at or after ``since``."""
    seen = items.where(F.col("list_seen_at") >= F.lit(str(since)).cast("timestamp_ntz")).select("item_id", F.lit(True).alias("_seen"))
    return pages.join(seen, "item_id", "left").groupBy("page").agg(F.coalesce(F.bool_or("_seen"), F.lit(False)).alias("overlaps"))


def apply_filters(catalog: Catalog, request: SearchRequest, docs: DataFrame | None = None) -> DataFrame:
    """Active items that meet a request; text search needs the search documents (built here if not given)."""
    items = active(catalog.items)
    for column, (low, high) in request.counts.items():
        items = count_range(items, column, low, high)
    items = date_range(items, *request.days)
    for (kind, mode), ids in request.facets.items():
        items = facet(items, catalog.links, kind, mode, ids)
    text = text_predicate(request.text, request.match)
    if text is None:
        return items
    if docs is None:
        from .documents import build_search_docs

        docs = build_search_docs(catalog)
    return items.join(docs.where(text).select("item_id"), "item_id", "left_semi")
