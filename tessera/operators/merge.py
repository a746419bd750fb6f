"""Merges of listing and detail snapshots into the catalogue, and published derived data.

Plain Parquet has no MERGE: each function returns the next version of a table as a full outer join of the current one and the
batch; ``publish`` writes it beside the old one and then marks it as complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_escapes
from ..functions.values import safe_url
from ..functions.workers import PACKED
from ..schema import Catalog
from .rankings import entity_stats
from .scoring import hot_score, ntz, with_scores

RECENT_DAYS = 30


def latest(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key by ``order``; partial aggregation keeps one row a key and task."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def _filled(items: DataFrame) -> DataFrame:
    """Adds missing bookkeeping columns as nulls, so that partial catalogues can be merged."""
    kinds = {
        "url": "string", "video_url": "string", "title": "string", "creator_id": "long", "creator_display_name": "string", "thumbnail_url": "string",
        "published_at": "timestamp_ntz", "view_count": "long", "favorite_count": "long", "comment": "string", "status": "string",
        "list_seen_at": "timestamp_ntz", "detail_fetched_at": "timestamp_ntz", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
    }
    return items.select("item_id", *((F.col(c) if c in items.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _merge(items: DataFrame, batch: DataFrame, change: dict[str, Column]) -> DataFrame:
    """Full outer join on item_id; ``change`` gives the columns of items in the batch, in terms of ``o.`` and ``b.``."""
    items = _filled(items)
    hit = F.col("b.item_id").isNotNull()
    joined = items.alias("o").join(batch.alias("b"), F.col("o.item_id") == F.col("b.item_id"), "full_outer")
    return joined.select(
        F.coalesce("o.item_id", "b.item_id").alias("item_id"),
        *(F.when(hit, change[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in change else F.col(f"o.{c}") for c in items.columns[1:]),
    )


def classify_listing(items: DataFrame, batch: DataFrame) -> DataFrame:
    """(item_id, is_new, list_changed, needs_detail) for the last sighting of each item of the batch."""
    new = latest(batch, ["item_id"], ["page", "pos"]).alias("b")
    old = _filled(items).alias("o")
    same = F.lit(True)
    for b, o in (("title", "title"), ("creator_name", "creator_display_name"), ("thumbnail_url", "thumbnail_url"), ("view_count", "view_count"), ("favorite_count", "favorite_count")):
        same = same & F.col(f"b.{b}").eqNullSafe(F.col(f"o.{o}"))
    is_new = F.col("o.item_id").isNull()
    gone = ~F.col("o.status").eqNullSafe(F.lit("active"))
    return new.join(old, F.col("b.item_id") == F.col("o.item_id"), "left").select(
        "b.item_id", is_new.alias("is_new"), (is_new | gone | ~same).alias("list_changed"), (is_new | gone | F.col("o.detail_fetched_at").isNull()).alias("needs_detail")
    )


def merge_listing(items: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Upsert of listing rows: new items become active; known ones keep their status, and their thumbnail if the new one is null."""
    new, at = latest(batch, ["item_id"], ["page", "pos"]), ntz(now)
    fresh = F.col("o.item_id").isNull()
    return _merge(items, new, {
        "url": F.col("b.url"), "title": F.col("b.title"), "creator_display_name": F.col("b.creator_name"),
        "thumbnail_url": F.coalesce("b.thumbnail_url", "o.thumbnail_url"), "view_count": F.col("b.view_count"), "favorite_count": F.col("b.favorite_count"),
        "status": F.when(fresh, "active").otherwise(F.col("o.status")), "list_seen_at": at, "created_at": F.when(fresh, at).otherwise(F.col("o.created_at")), "updated_at": at,
    })


def merge_detail(items: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Upsert of details: all fields are overwritten, nulls included, but a null thumbnail; missing items become active."""
    at, fresh = ntz(now), F.col("o.item_id").isNull()
    order = [c for c in ("seq", "item_id") if c in batch.columns]
    new = latest(batch, ["item_id"], order) if "seq" in batch.columns else batch
    plain = ("url", "video_url", "title", "published_at", "view_count", "favorite_count", "comment")
    return _merge(items, new, {
        **{c: F.col(f"b.{c}") for c in plain}, "creator_id": F.col("b.creator.id"), "creator_display_name": F.col("b.creator.name"),
        "thumbnail_url": F.coalesce("b.thumbnail_url", "o.thumbnail_url"), "status": F.lit("active"), "detail_fetched_at": at,
        "created_at": F.when(fresh, at).otherwise(F.col("o.created_at")), "updated_at": at,
    })


def merge_missing(items: DataFrame, gone: DataFrame, now) -> DataFrame:
    """Marks items (item_id, url) as missing; unknown ones become stubs, known ones keep their other fields."""
    at, fresh = ntz(now), F.col("o.item_id").isNull()
    return _merge(items, gone.dropDuplicates(["item_id"]), {
        "url": F.col("b.url"), "title": F.when(fresh, "").otherwise(F.col("o.title")), "status": F.lit("missing"), "detail_fetched_at": at,
        "created_at": F.when(fresh, at).otherwise(F.col("o.created_at")), "updated_at": at,
    })


def merge_entities(entities: DataFrame, refs: DataFrame, now) -> DataFrame:
    """Upsert of ``refs`` (kind, entity_id, name, url, seq): the last name wins, a null URL does not replace one."""
    at = ntz(now)
    new = refs.groupBy("kind", "entity_id").agg(F.max_by("name", "seq").alias("name"), F.max_by("url", F.when(F.col("url").isNotNull(), F.col("seq"))).alias("url"))
    old = entities.select("kind", "entity_id", "name", *((F.col(c) if c in entities.columns else F.lit(None)).cast(t).alias(c) for c, t in (("url", "string"), ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"))))
    hit = F.col("b.entity_id").isNotNull()
    return old.alias("o").join(new.alias("b"), (F.col("o.kind") == F.col("b.kind")) & (F.col("o.entity_id") == F.col("b.entity_id")), "full_outer").select(
        F.coalesce("o.kind", "b.kind").alias("kind"), F.coalesce("o.entity_id", "b.entity_id").alias("entity_id"), F.coalesce("b.name", "o.name").alias("name"),
        F.coalesce("b.url", "o.url").alias("url"), F.when(F.col("o.entity_id").isNull(), at).otherwise(F.col("o.created_at")).alias("created_at"),
        F.when(hit, at).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def entity_refs(details: DataFrame) -> DataFrame:
    """(item_id, kind, entity_id, name, url, seq) of all links of detail records."""
    kinds = {"authors": F.when(F.col("creator").isNotNull(), F.array("creator")), "tags": F.col("tags"), "origins": F.col("origins"), "characters": F.col("characters")}
    seq = F.col("seq") if "seq" in details.columns else F.col("item_id")
    parts = [details.select("item_id", F.lit(k).alias("kind"), seq.alias("seq"), F.explode(c).alias("x")) for k, c in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "kind", F.col("x.id").alias("entity_id"), F.col("x.name").alias("name"), F.col("x.url").alias("url"), "seq")


def replace_links(links: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """All links of the touched items (item_id) are replaced by ``new`` (item_id, kind, entity_id)."""
    kept = links.join(touched.select("item_id").distinct(), "item_id", "left_anti")
    return kept.select("item_id", "kind", "entity_id").unionByName(new.select("item_id", "kind", "entity_id").distinct())


def refresh_hot(items: DataFrame, as_of, full: bool = True) -> DataFrame:
    """Hot scores of active items; a quiet refresh recomputes those of the last 30 days only and keeps the others."""
    if full:
        return with_scores(items, as_of)
    recent = (F.col("status") == "active") & (F.col("published_at") >= F.date_sub(ntz(as_of).cast("date"), RECENT_DAYS).cast("timestamp_ntz"))
    return items.withColumn("hot_score", F.when(recent, hot_score(as_of)).otherwise(F.col("hot_score")))


def refresh_derived(catalog: Catalog, as_of, full: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(items with scores, entity statistics); without changes in the catalogue the statistics are not rebuilt."""
    return refresh_hot(catalog.items, as_of, full), entity_stats(catalog, as_of) if full else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, the newest first: those whose folder has the mark of a finished write."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted((int(x.getPath().getParent().getName().removeprefix("v=")) for x in found or ()), reverse=True)


def publish(df: DataFrame, path: str, version: int) -> None:
    """Writes a version of a table; readers see it from the moment the write is committed, and never half of it.

    A repeated version is left as it is, so a repeated epoch does no harm.
    """
    if version not in _versions(df.sparkSession, path):
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v={version}", compression=PACKED)


def current_version(spark: SparkSession, path: str) -> int:
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no complete version in {path}")
    return versions[0]


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={current_version(spark, path)}")


def numbered(df: DataFrame, key: str, bins: int = 1024) -> DataFrame:
    """Adds ``_number``, the row's number from 1 on by ``key`` (nulls first), without sorting all rows in one task.

    Bins follow approximate quantiles, so far-off keys do no harm; their counts (at most ``bins`` + 1 rows) give offsets, and rows are
    numbered within bins.
    """
    cuts = df.approxQuantile(key, [k / bins for k in range(1, bins)], 0.2 / bins) if bins > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    df = df.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(0.0)))
    df = Bucketizer(splits=splits, inputCol="_at", outputCol="_bin").transform(df).drop("_at") if len(splits) > 2 else df.withColumn("_bin", F.lit(0.0)).drop("_at")
    df = df.withColumn("_bin", F.when(F.col(key).isNull(), -1.0).otherwise(F.col("_bin")))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("_bin").agg(F.count("*").alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy(key))
    return df.withColumn("_in", rank).join(F.broadcast(offsets), "_bin").withColumn("_number", F.col("_in") + F.col("_before")).drop("_bin", "_in", "_before")


def export_chunks(items: DataFrame, chunk: int = 50_000) -> DataFrame:
    """(chunk, pos, item_id, lastmod) of active items by id; write with ``partitionBy('chunk')``."""
    stamp = F.coalesce(*(F.col(c) for c in ("updated_at", "published_at") if c in items.columns))
    rows = numbered(items.where(F.col("status") == "active").select("item_id", stamp.cast("date").alias("lastmod")), "item_id")
    n = F.col("_number") - 1
    return rows.select(F.floor(n / chunk).cast("long").alias("chunk"), F.pmod(n, F.lit(chunk)).cast("long").alias("pos"), "item_id", "lastmod")


def chunk_index(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.max("lastmod").alias("lastmod"))


def backfill_urls(items: DataFrame, hosts: dict[str, Sequence[str]]) -> DataFrame:
    """Nulls out URLs that fail their column's list of hosts; ``changed`` marks the rows to rewrite."""
    fixed = {c: safe_url(F.col(c), h) for c, h in hosts.items()}
    changed = F.lit(False)
    for c, x in fixed.items():
        changed = changed | ~x.eqNullSafe(F.col(c))
    return items.withColumn("changed", changed).withColumns(fixed)


def backfill_comments(items: DataFrame) -> DataFrame:
    """Decodes stored escapes where a comment has a backslash; only those rows reach the Arrow function's work."""
    return items.withColumn("comment", F.when(F.contains("comment", F.lit("\\")), decode_escapes(F.col("comment"))).otherwise(F.col("comment")))
