"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is shared again by weight until no target is above (water filling, solved
by sorting sources by words per weight).

Selection: a document's key is an exponential variate, from a hash of its id and text, divided by its quality weight. Within a source documents stand
in key order. A source's whole epochs come first (every document once each); for the rest of the budget the documents
with the smallest keys are taken, as whole documents, up to the document whose end lies nearest to the budget.

The sort is not done as one: keys fall into ``BINS`` ordered bins, words are summed by source and bin, and only the bin
in which a source's budget ends is sorted. The outcome is a cut per source, so the documents themselves need no
shuffle: joins with the labels and with the table of cuts (each broadcast only if its rows are few, by count) say what is taken.

Only DataFrame functions are used. Defined results: a null or blank text has size 0 and takes nothing; a null source is
a source of its own; rows with the same source, doc_id and text share one key and are taken together (documents
with one id, or none, and different texts are drawn by themselves); a document with several
labels has the best of them; an empty table gives an empty result; other columns pass through ``mix``, whatever their names
(result names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, table

BINS = 2048
SEED = "mix-1"
SHARE = 1.5
MOST_EPOCHS = 2
#: Quality weights: a good label, no label, a bad label.
GOOD, NONE, BAD = 2.0, 1.0, 0.5
#: Up to so many sources the table of cuts is broadcast (a row has under 200 bytes besides the name).
FEW_SOURCES = 20_000
#: Up to so many labelled documents (two numbers each) the labels are broadcast.
FEW_LABELS = 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(c: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table (source, source_size) of one row a source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("_rank") % 3 + 1).cast("int")).cast("double")
    t = sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", weight)
    t = t.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        t.withColumn("_left", share * F.sum("source_size").over(everything) - (F.sum("_cap").over(up) - F.col("_cap")))
        .withColumn("_left_w", F.sum("_w").over(everything) - (F.sum("_w").over(up) - F.col("_w")))
        .withColumn("_full", F.col("_cap") / F.col("_w") * F.col("_left_w") <= F.col("_left"))
    )
    level = (
        share * F.sum("source_size").over(everything) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    ) / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    t = t.withColumn("_level", level)
    return t.select(
        *sizes.columns,
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level")).alias("target"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (with source, doc_id, quality, digest) with source key, sampling key and its bin, without digest."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "_digest")), 1, 12), 16, 10)
    uniform = (number.cast("double") + 0.5) / float(1 << 48)
    weight = F.when(F.col("quality") > 0, GOOD).when(F.col("quality") == 0, BAD).otherwise(NONE)
    return (
        docs.withColumn("_key", -F.log(uniform) / weight)
        .withColumn("_bin", F.floor(BINS * (1 - F.exp(-F.col("_key")))).cast("int"))
        .withColumn("_s", _source(F.col("source")))
        .drop("_digest")
    )


def _text_digest() -> Column:
    """Tells documents with one id, or none, apart by their texts."""
    return F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_digest")


def _with_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return docs.withColumn("quality", F.lit(None).cast("int"))
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(F.broadcast(best) if best.count() <= FEW_LABELS else best, "doc_id", "left")


def plan(rows: DataFrame) -> DataFrame:
    """A row for each source: its target, its epochs, and where the fractional selection ends.

    ``rows`` has doc_id, source, size and the columns of ``_keyed``.
    """
    sizes = rows.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(sizes).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    )
    goal = materialise(goal.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    bins = rows.groupBy("_s", "_bin").agg(F.sum("size").alias("_words"))
    so_far = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        bins.withColumn("_before", F.sum("_words").over(so_far) - F.col("_words"))
        .join(goal.select("_s", "_rest"), "_s")
        .where((F.col("_rest") > 0) & (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
    )
    peers = rows.join(last.select("_s", "_bin", "_before", "_rest"), ["_s", "_bin"]).groupBy(
        "_s", "_bin", "_before", "_rest", "_key", "doc_id"
    ).agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("_s").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = peers.withColumn("_end", F.col("_before") + F.sum("size").over(inside))
    taken = (F.col("_end") <= F.col("_rest")) | (
        (F.col("_end") - F.col("size") < F.col("_rest"))
        & (F.col("_end") - F.col("_rest") <= F.col("_rest") - (F.col("_end") - F.col("size")))
    )
    cut = end.groupBy("_s").agg(
        F.first("_bin").alias("_cut_bin"),
        F.max(F.when(taken, F.struct(F.col("_key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")))).alias("_cut"),
    )
    out = materialise(goal.join(cut, "_s", "left"))
    forget(goal)
    return out


def taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds source_size, target, epochs, selected (in the fractional part) and taken to rows of ``_keyed``."""
    side = cuts.select("_s", "source_size", "target", "epochs", "_cut_bin", "_cut")
    here = F.struct(F.col("_key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"))
    picked = (F.col("_bin") < F.col("_cut_bin")) | ((F.col("_bin") == F.col("_cut_bin")) & (here <= F.col("_cut")))
    return (
        rows.join(F.broadcast(side) if cuts.count() <= FEW_SOURCES else side, "_s")
        .withColumn("selected", F.coalesce(picked, F.lit(False)))
        .withColumn("taken", (F.col("size") * (F.col("epochs") + F.col("selected").cast("int"))).cast("long"))
    )


_MADE = ("size", "source_size", "target", "epochs", "selected", "taken")


def _mixed(docs: DataFrame, own: list[str], labels: DataFrame | None) -> DataFrame:
    """The columns ``own`` as a struct ``row``, with what the mix says of each row."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), _text_digest())
    rows = _keyed(_with_quality(rows, labels))
    narrow = materialise(rows.select("doc_id", "source", "size", "_key", "_bin", "_s"))
    out = taken(rows, plan(narrow)).select("row", *_MADE)
    forget(narrow)
    return out


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, epochs, selected (in the fractional part) and taken."""
    return _mixed(docs, [c for c in docs.columns if c not in _MADE], labels).select("row.*", *_MADE)


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = F.col("epochs") + F.col("selected").cast("int")
    return _mixed(docs, docs.columns, labels).where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_digest(docs, table(spark, sf_dir, "labels"))


def mix_digest(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The result of ``mix`` without the texts, which are read once only."""
    narrow = materialise(_keyed(_with_quality(docs.select("doc_id", "source", words(F.col("text")).alias("size"), _text_digest()), labels)))
    return taken(narrow, plan(narrow)).select("doc_id", *_MADE, "source")


OP9_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows_ AS (
  SELECT d.doc_id, d.source, coalesce('=' || d.source, '') AS s,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '-') || '|' || md5(coalesce(d.text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
           / (CASE WHEN q > 0 THEN 2.0::DOUBLE WHEN q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents d LEFT JOIN best USING (doc_id)
),
sizes AS (SELECT s, min(source) AS source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY s),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank_ FROM sizes),
weighed AS (SELECT *, (CASE rank_ % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
level_ AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER up - cap) AS left_,
         sum(w) OVER () - (sum(w) OVER up - w) AS left_w
  FROM weighed WINDOW up AS (ORDER BY cap / w, rank_ ROWS UNBOUNDED PRECEDING)
),
full_ AS (SELECT *, cap / w * left_w <= left_ AS full_ FROM level_),
goal AS (
  SELECT s, source, source_size,
         CASE WHEN full_ THEN cap ELSE w * ((1.5::DOUBLE * sum(source_size) OVER () - sum(CASE WHEN full_ THEN cap ELSE 0.0::DOUBLE END) OVER ())
              / sum(CASE WHEN full_ THEN 0.0::DOUBLE ELSE w END) OVER ()) END AS target
  FROM full_
),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INTEGER AS epochs FROM goal),
ordered AS (
  SELECT r.doc_id, r.source, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.s ORDER BY r.k, r.doc_id RANGE UNBOUNDED PRECEDING) AS end_,
         sum(r.size) OVER (PARTITION BY r.s, r.k, r.doc_id) AS peers
  FROM rows_ r JOIN epochs e ON r.s = e.s
),
chosen AS (
  SELECT *, rest > 0 AND (end_ <= rest OR (end_ - peers < rest AND end_ - rest <= rest - (end_ - peers))) AS selected FROM ordered
)
SELECT doc_id, size, source_size, target, (size * (epochs + selected::INTEGER))::BIGINT AS taken, source, epochs, selected FROM chosen
"""
