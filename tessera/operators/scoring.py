"""Popularity and time-decayed scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import micros


def popularity() -> Column:
    return F.coalesce("view_count", F.lit(0)) + F.coalesce("favorite_count", F.lit(0)) * 50


def ntz(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def hot_score(as_of: datetime | str) -> Column:
    """Popularity over age in hours plus six; ``as_of`` is on the same clock as ``published_at``."""
    published = F.coalesce("published_at", ntz("1970-01-01 00:00:00"))
    hours = (micros(ntz(as_of)) - micros(published)) / 3.6e9
    return popularity() / (F.greatest(hours, F.lit(0.0)) + 6.0)


def with_scores(items: DataFrame, as_of: datetime | str) -> DataFrame:
    """Adds popularity and hot_score; items that are not active have a hot score of 0."""
    return items.withColumn("popularity", popularity()).withColumn("hot_score", F.when(F.col("status") == "active", hot_score(as_of)).otherwise(0.0))
