"""Tables of the catalogue and the search request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# ---- fixed values: kinds of entities, how each can be filtered, sort modes
KINDS = ("authors", "tags", "origins", "characters")
FACET_MODES = {"authors": ("any", "not"), "origins": ("any", "not"), "characters": ("any", "not"), "tags": ("all", "any", "not")}
SORT_MODES = (
    "published_desc", "published_asc", "hot_desc", "popularity_desc", "favorites_desc", "favorites_asc", "views_desc", "views_asc",
)
# ---- end of fixed values
#: Name of a facet's request parameter: (kind, mode)
FACETS = {f"{kind.removesuffix('s')}_{mode}": (kind, mode) for kind, modes in FACET_MODES.items() for mode in modes}
#: Counts that can be bounded: column
COUNTS = {"views": "view_count", "favorites": "favorite_count"}

ITEMS = (
    "item_id long, url string, video_url string, title string, creator_id long, creator_display_name string, thumbnail_url string, "
    "published_at timestamp_ntz, view_count long, favorite_count long, comment string, status string, list_seen_at timestamp_ntz, "
    "detail_fetched_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
ENTITIES = "kind string, entity_id long, name string, url string, created_at timestamp_ntz, updated_at timestamp_ntz"
LINKS = "item_id long, kind string, entity_id long"
FAILURES = (
    "entity_type string, entity_id string, operation string, url string, error_type string, error_message string, attempts int, "
    "last_failed_at timestamp_ntz, next_retry_at timestamp_ntz"
)


@dataclass
class Catalog:
    """items, entities (one table for all kinds) and links (creators included, as kind ``authors``)."""

    items: DataFrame
    entities: DataFrame
    links: DataFrame


@dataclass
class SearchRequest:
    """What to look for: all conditions hold together.

    ``facets`` are ids by (kind, mode), ``days`` the first and the last day (empty: open), ``counts`` lower and upper bounds by column.
    """

    text: str = ""
    match: str = "all"  # of the text's tokens
    facets: dict[tuple[str, str], list[int]] = field(default_factory=dict)
    days: tuple[str, str] = ("", "")
    counts: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)
    order: str = "published_desc"
