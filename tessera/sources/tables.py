"""Catalogue scans: Parquet catalogues, and the star-schema tables read as one (orders are items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITIES, ITEMS, LINKS, Catalog


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """A catalogue stored as ``items``, ``entities`` (by kind) and ``links`` (by kind)."""
    return Catalog(
        spark.read.schema(ITEMS).parquet(f"{path}/items"),
        spark.read.schema(ENTITIES).parquet(f"{path}/entities"),
        spark.read.schema(LINKS).parquet(f"{path}/links"),
    )


def save_catalog(catalog: Catalog, path: str) -> None:
    """Items sorted by date within files (row groups skip by date), links and entities in a folder for each kind."""
    catalog.items.sortWithinPartitions("published_at").write.mode("overwrite").parquet(f"{path}/items")
    catalog.entities.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/entities")
    catalog.links.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/links")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders as items, customers as creators, parts as tags, suppliers as characters, their nations as origins."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem")
    favorites = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.floor(F.sum("l_quantity")).cast("long").alias("favorite_count"))
    customers = read("customer").select("c_custkey", "c_name", "c_mktsegment")
    items = (
        read("orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("item_id"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
            F.col("o_custkey").alias("creator_id"),
            F.col("c_name").alias("creator_display_name"),
            F.col("o_orderdate").alias("published_at"),
            F.floor("o_totalprice").cast("long").alias("view_count"),
            F.when(F.col("o_orderstatus") == "P", "missing").otherwise("active").alias("status"),
        )
        .join(favorites, "item_id", "left")
    )
    suppliers = read("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    entity = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("entity_id"), F.col(name).alias("name"))
    entities = (
        entity(customers, "authors", "c_custkey", "c_name")
        .unionByName(entity(read("part"), "tags", "p_partkey", "p_name"))
        .unionByName(entity(suppliers, "characters", "s_suppkey", "s_name"))
        .unionByName(entity(read("nation"), "origins", "n_nationkey", "n_name"))
    )
    by_line = lines.select(F.col("l_orderkey").alias("item_id"), "l_partkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    # dealt by item before a line becomes three links, so that ``distinct`` finds equal ones together
    by_line = by_line.repartition("item_id").select(
        "item_id",
        F.explode(F.array(*(
            F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("entity_id"))
            for kind, c in (("tags", "l_partkey"), ("characters", "l_suppkey"), ("origins", "s_nationkey"))
        ))).alias("x"),
    )
    links = by_line.select("item_id", "x.kind", "x.entity_id").where("entity_id is not null").distinct()
    creators = read("orders").where("o_custkey is not null").select(F.col("o_orderkey").alias("item_id"), F.lit("authors").alias("kind"), F.col("o_custkey").alias("entity_id"))
    return Catalog(items, entities, links.unionByName(creators))
