"""Inputs that the registered queries share, as DataFrames and as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import free, shared_root
from ..operators import merge as mg
from ..operators.commits import CommitLog
from ..operators.documents import build_search_docs
from ..operators.rankings import entity_stats
from ..operators.ranks import RankFiles
from ..operators.scoring import with_scores
from ..operators.segments import SegmentIndex
from ..schema import Catalog
from ..sources.tables import load_catalog, orders_catalog, save_catalog, table

AS_OF = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-02-01 00:00:00"

ITEMS_SQL = """
fav AS (SELECT l_orderkey AS item_id, floor(sum(l_quantity))::BIGINT AS favorite_count FROM lineitem GROUP BY 1),
items AS (
  SELECT o_orderkey AS item_id, concat_ws(' ', o_orderpriority, c_mktsegment) AS title, o_custkey AS creator_id, c_name AS creator_display_name,
         o_orderdate AS published_at, floor(o_totalprice)::BIGINT AS view_count, favorite_count,
         CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'active' END AS status,
         coalesce(floor(o_totalprice)::BIGINT, 0) + coalesce(favorite_count, 0) * 50 AS popularity
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN fav ON o_orderkey = fav.item_id
),
entities AS (
  SELECT 'authors' AS kind, c_custkey AS entity_id, c_name AS name FROM customer UNION ALL SELECT 'tags', p_partkey, p_name FROM part
  UNION ALL SELECT 'characters', s_suppkey, s_name FROM supplier UNION ALL SELECT 'origins', n_nationkey::BIGINT, n_name FROM nation
),
links AS (
  SELECT o_orderkey AS item_id, 'authors' AS kind, o_custkey AS entity_id FROM orders
  UNION SELECT l_orderkey, 'tags', l_partkey FROM lineitem UNION SELECT l_orderkey, 'characters', l_suppkey FROM lineitem
  UNION SELECT l_orderkey, 'origins', s_nationkey::BIGINT FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
active AS (SELECT *, popularity / (greatest((epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(coalesce(published_at, TIMESTAMP '1970-01-01')))::DOUBLE / 3.6e9, 0.0) + 6.0) AS hot_score
  FROM items WHERE status = 'active'),
stats AS (
  SELECT l.kind, l.entity_id, e.name, count(*) AS item_count, coalesce(sum(view_count), 0)::BIGINT AS total_views, coalesce(sum(favorite_count), 0)::BIGINT AS total_favorites,
         sum(popularity)::BIGINT AS popularity, sum(hot_score) AS hot
  FROM links l JOIN active USING (item_id) JOIN entities e ON e.kind = l.kind AND e.entity_id = l.entity_id GROUP BY 1, 2, 3
)
"""
WITH = f"WITH {ITEMS_SQL}"

RICH_SQL = f"""{WITH},
rich AS (
  SELECT item_id, 'https://example.com/movies/' || item_id AS url, NULL::VARCHAR AS video_url, title, creator_id, creator_display_name,
         CASE WHEN favorite_count > 60 THEN 'https://example.com/t/' || item_id END AS thumbnail_url, published_at, view_count, favorite_count,
         'said \\n' || title AS comment, status, published_at AS list_seen_at,
         CASE WHEN title NOT LIKE '2-HIGH%' THEN published_at + INTERVAL 1 DAY END AS detail_fetched_at, published_at AS created_at, published_at AS updated_at
  FROM items
),
batch AS (
  SELECT item_id // 36 AS page, item_id % 36 AS pos, item_id, url, title, creator_display_name AS creator_name, NULL::VARCHAR AS thumbnail_url,
         view_count + CASE WHEN favorite_count > 100 THEN 1 ELSE 0 END AS view_count, favorite_count FROM rich WHERE title LIKE '1-URGENT%'
  UNION ALL
  SELECT item_id // 36, item_id % 36, item_id + 10000000, 'https://example.com/movies/' || (item_id + 10000000), title, creator_display_name, thumbnail_url, view_count, favorite_count
  FROM rich WHERE title LIKE '5-LOW%'
)"""


class ReadModel:
    """Tables that readers use, derived once from the tables of a folder and published: the catalogue, entity statistics, search documents,
    their index, and items laid out by each order. Each is written when it is first asked for; ``read_model`` makes a new one when the tables change."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        self.spark, self.sf_dir, self.root, self._stored = spark, sf_dir, root, set()
        self._ranks = RankFiles(CommitLog(spark, f"{root}/ranks"))

    def catalog(self) -> Catalog:
        if "catalog" not in self._stored:
            save_catalog(orders_catalog(self.spark, self.sf_dir), f"{self.root}/catalog")
            self._stored.add("catalog")
            free(self.spark)
        return load_catalog(self.spark, f"{self.root}/catalog")

    def _published(self, name: str, build) -> DataFrame:
        if name not in self._stored:
            mg.publish(build(), f"{self.root}/{name}", 1)
            self._stored.add(name)
            free(self.spark)
        return mg.current(self.spark, f"{self.root}/{name}")

    def stats(self) -> DataFrame:
        return self._published("stats", lambda: entity_stats(self.catalog(), AS_OF))

    def docs(self) -> DataFrame:
        return self._published("docs", lambda: build_search_docs(self.catalog()))

    def segments(self) -> SegmentIndex:
        """The search documents in an index of segments."""
        index = SegmentIndex(CommitLog(self.spark, f"{self.root}/segments"))
        if "segments" not in self._stored:
            index.add(self.docs())
            self._stored.add("segments")
        return index

    def ranks(self) -> RankFiles:
        """Items with their scores, laid out by each order."""
        if "ranks" not in self._stored:
            self._ranks.build(with_scores(self.catalog().items, AS_OF))
            self._stored.add("ranks")
        return self._ranks


#: Bytes of the tables for each partition of a shuffle; more partitions than the session asks for are set only for larger tables.
PER_PARTITION = 2 << 20
#: At most so many bytes of a shuffle are joined again for one task, and so many of files read by one: rows that pack into few bytes there take
#: fifty times as many in a hash table or a sort. Sessions that ask for less keep it.
PER_TASK = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 4 << 20, "spark.sql.files.maxPartitionBytes": 8 << 20}
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_TABLES = ("orders", "lineitem", "customer", "part", "supplier", "nation")
_models: dict[tuple, ReadModel] = {}


def read_model(spark: SparkSession, sf_dir: str) -> ReadModel:
    """The read model of the tables in ``sf_dir`` as they are now (by size and time of change)."""
    conf, state = spark._jsc.hadoopConfiguration(), []
    for name in _TABLES:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = where.getFileSystem(conf)
        state.append((fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength()))
    # partitions grow with the tables, so that a task's memory does not; small ones are joined again by Spark
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(size for _, size in state) // PER_PARTITION)
    if parts > int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(parts))
    for name, most in PER_TASK.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _models:
        _models[key] = ReadModel(spark, sf_dir, f"{shared_root(spark)}/read-model-{uuid.uuid4().hex}")
    return _models[key]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return read_model(spark, sf_dir).catalog()


def rich_items(c: Catalog) -> DataFrame:
    """Items of the orders catalogue with URLs, comments and bookkeeping times."""
    i = c.items
    n = F.col("item_id").cast("string")
    return i.select(
        "item_id", F.concat(F.lit("https://example.com/movies/"), n).alias("url"), F.lit(None).cast("string").alias("video_url"), "title", "creator_id", "creator_display_name",
        F.when(F.col("favorite_count") > 60, F.concat(F.lit("https://example.com/t/"), n)).alias("thumbnail_url"), "published_at", "view_count", "favorite_count",
        F.concat(F.lit("said \\n"), "title").alias("comment"), "status", F.col("published_at").alias("list_seen_at"),
        F.when(~F.col("title").startswith("2-HIGH"), F.col("published_at") + F.expr("interval 1 day")).alias("detail_fetched_at"),
        F.col("published_at").alias("created_at"), F.col("published_at").alias("updated_at"),
    )


def listing_batch(rich: DataFrame) -> DataFrame:
    """A listing: urgent items again, some with another count, and low ones under new ids."""
    bump = F.col("view_count") + F.when(F.col("favorite_count") > 100, 1).otherwise(0)
    cols = lambda df, shift, views, thumb: df.select(
        F.floor(F.col("item_id") / 36).alias("page"), (F.col("item_id") % 36).alias("pos"), (F.col("item_id") + shift).alias("item_id"),
        F.concat(F.lit("https://example.com/movies/"), (F.col("item_id") + shift).cast("string")).alias("url"), "title", F.col("creator_display_name").alias("creator_name"),
        thumb.cast("string").alias("thumbnail_url"), views.alias("view_count"), "favorite_count",
    )
    return cols(rich.where(F.col("title").startswith("1-URGENT")), 0, bump, F.lit(None)).unionByName(
        cols(rich.where(F.col("title").startswith("5-LOW")), 10_000_000, F.col("view_count"), F.col("thumbnail_url"))
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an access log."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.lit("GET").alias("method"), F.col("event_type").alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 1000).alias("duration"), F.col("user_id").alias("client"), F.to_date("ts").alias("run_id"),
    )


LOG_SQL = """WITH log AS (SELECT event_id, ts, 'GET' AS method, event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 1000 AS duration,
  user_id AS client, ts::DATE AS run_id FROM events)"""


def failure_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.lit("item").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lit("detail").alias("operation"), F.concat(F.lit("https://example.com/"), F.col("event_id").cast("string")).alias("url"),
        F.lit("Timeout").alias("error_type"), F.col("props").alias("error_message"), F.col("event_id").alias("seq"), "ts",
    )


FAIL_SQL = """WITH batch AS (SELECT 'item' AS entity_type, user_id::VARCHAR AS entity_id, 'detail' AS operation, 'https://example.com/' || event_id AS url, 'Timeout' AS error_type,
  props AS error_message, event_id AS seq, ts FROM events WHERE event_type = 'error')"""


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order as listing pages of 36 rows: (page, item_id, is_new, _mark)."""
    from ..operators.merge import numbered

    rows = numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id")
    first = rows.groupBy("user_id").agg(F.min("_number").alias("_first"))
    rows = rows.join(first, "user_id")
    return rows.select(
        (F.floor((F.col("_number") - 1) / 36) + 1).cast("long").alias("page"), F.col("user_id").alias("item_id"), (F.col("_number") == F.col("_first")).alias("is_new"),
        (F.get_json_object("props", "$.k") == "7").alias("_mark"),
    )


PAGES_SQL = """WITH numbered AS (
  SELECT user_id, props, row_number() OVER (ORDER BY event_id) AS n FROM events
), firsts AS (SELECT *, min(n) OVER (PARTITION BY user_id) AS first_n FROM numbered),
rows_ AS (SELECT (n - 1) // 36 + 1 AS page, user_id AS item_id, n = first_n AS is_new, json_extract_string(props, '$.k') = '7' AS mark FROM firsts),
pages_ AS (SELECT page, bool_or(is_new) AS has_new, count(*) FILTER (mark) >= 3 AS failed, max(max(page)) OVER () AS last_page FROM rows_ GROUP BY page)"""


def page_flags(rows: DataFrame) -> DataFrame:
    """(page, has_new, failed, last_page) of listing pages; three marked rows stand for a failed page."""
    p = rows.groupBy("page").agg(F.bool_or("is_new").alias("has_new"), (F.count_if("_mark") >= 3).alias("failed"))
    return p.join(F.broadcast(p.agg(F.max("page").alias("last_page"))))  # one row
