"""Search requests as rows: validation, normalisation and canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_query_tokens
from ..functions.values import parse_bounded_int, parse_csv_ids
from ..schema import COUNTS, FACETS, SORT_MODES

MOST_IDS, LONGEST, MOST_PAGES = 20, 200, 100_000
ALIASES = {"hot": "hot_desc", "popularity": "popularity_desc", "latest": "published_desc", "favorites": "favorites_desc", "views": "views_desc"}
RANGES = tuple(f"{side}_{name}" for name in COUNTS for side in ("min", "max"))


def normalise(requests: DataFrame) -> DataFrame:
    """Typed requests from raw strings; columns may be missing.

    Values that make no sense are ignored (another sort, a bad date, junk numbers); rows beyond the structural limits are marked
    ``rejected``.
    """
    have = set(requests.columns)
    raw = lambda c: F.trim(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    sort = F.coalesce(*(F.when(raw("sort") == k, v) for k, v in ALIASES.items()), F.when(raw("sort").isin(*SORT_MODES), raw("sort")), F.lit("published_desc"))
    date = lambda c: F.coalesce(F.when(raw(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(raw(c), "yyyy-MM-dd"), "yyyy-MM-dd")), F.lit(""))
    page = F.coalesce(raw("page").try_cast("long"), F.lit(1))
    rejected = (F.length(F.coalesce(raw("q"), F.lit(""))) > LONGEST) | (page < 1) | (page > MOST_PAGES)
    for c in FACETS:
        rejected = rejected | (F.length(F.coalesce(raw(c), F.lit(""))) > MOST_IDS * 12)
    return requests.select(
        "query_id", F.coalesce(raw("q"), F.lit("")).alias("q"), split_query_tokens(raw("q")).alias("tokens"), F.when(raw("title_mode") == "any", "any").otherwise("all").alias("title_mode"),
        *(parse_csv_ids(raw(c), MOST_IDS).alias(c) for c in FACETS), date("published_from").alias("published_from"), date("published_to").alias("published_to"),
        *(parse_bounded_int(raw(c)).alias(c) for c in RANGES), sort.alias("sort"), page.alias("page"), rejected.alias("rejected"),
    )


def canonical(requests: DataFrame) -> DataFrame:
    """Adds the minimal canonical query string (sorted by name) and the number of active refinement groups."""
    text = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"{c}="), c))
    parts = [
        text("q"), F.when(F.col("title_mode") != "all", F.concat(F.lit("title_mode="), "title_mode")), *(F.when(F.size(c) > 0, F.concat(F.lit(f"{c}="), F.array_join(c, ","))) for c in FACETS),
        text("published_from"), text("published_to"), *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in RANGES), F.when(F.col("sort") != "published_desc", F.concat(F.lit("sort="), "sort")),
    ]
    flags = [F.size(c) > 0 for c in FACETS] + [(F.col("published_from") != "") | (F.col("published_to") != "")]
    flags += [F.col(f"min_{c}").isNotNull() | F.col(f"max_{c}").isNotNull() for c in COUNTS]
    return requests.withColumn("canonical", F.array_join(F.array_sort(F.array_compact(F.array(*parts))), "&")).withColumn("active_filters", sum((f.cast("int") for f in flags), F.lit(0)))
