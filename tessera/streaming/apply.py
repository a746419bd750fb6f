"""Micro-batches of detail outcomes applied to a catalogue: to tables of versions, or to a group of tables with one commit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import CommitLog, Entry, id_part, merge_parts, retried
from ..operators.incremental import DRIFT_DETAILS, clear_failures, merge_failures
from ..operators.merge import latest, merge_detail, merge_missing, publish
from ..operators.scoring import ntz


def apply_outcomes(items: DataFrame, ledger: DataFrame, outcomes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(items, ledger) after ``outcomes`` (item_id, outcome ok | missing | error, seq, and a detail record's fields)."""
    last = latest(outcomes, ["item_id"], ["seq"])
    items = merge_detail(items, last.where("outcome = 'ok'"), now)
    items = merge_missing(items, last.where("outcome = 'missing'").select("item_id", "url"), now)
    key = lambda df: df.select(F.lit("item").alias("entity_type"), F.col("item_id").cast("string").alias("entity_id"), F.lit("detail").alias("operation"), "url", F.col("outcome").alias("error_type"), F.col("comment").alias("error_message"), "seq")
    ledger = merge_failures(clear_failures(ledger, key(last.where("outcome <> 'error'"))), key(outcomes.where("outcome = 'error'")), now)
    return items, ledger


def run_row(outcomes: DataFrame, epoch: int, now) -> DataFrame:
    """One row for a micro-batch: counters by outcome, whether too many details could not be parsed (then its data are not to be
    trusted), and the status."""
    count = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counters = outcomes.agg(count("ok").alias("details_fetched"), count("missing").alias("missing_items"), count("error", "drift").alias("failed_details"), count("drift").alias("drift_errors"))
    drift = F.col("drift_errors") >= DRIFT_DETAILS
    return counters.select(
        F.lit(epoch).cast("long").alias("run_id"), F.when(drift, "failed").when(F.col("failed_details") > 0, "partial").otherwise("success").alias("status"), ntz(now).alias("finished_at"),
        "details_fetched", "missing_items", "failed_details", "drift_errors",
    )


def stream_outcomes(outcomes: DataFrame, path: str, checkpoint: str, now):
    """Applies a stream of outcomes. Every epoch reads version n of items and ledger and publishes n + 1, then its row of ``runs``; a repeated
    epoch finds its versions complete. An epoch with too many unreadable details changes no item: only its failures and its row are kept."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        version = lambda name: spark.read.parquet(f"{path}/{name}/v={epoch}")
        run = run_row(batch, epoch, now)
        publish(run, f"{path}/runs", epoch)
        stopped = version("runs").first()["status"] == "failed"
        failed = F.col("outcome").isin("error", "drift")
        batch = batch.withColumn("outcome", F.when(failed, "error").otherwise(F.col("outcome")))
        items, ledger = apply_outcomes(version("items"), version("ledger"), batch.where(failed) if stopped else batch, now)
        publish(items, f"{path}/items", epoch + 1)
        publish(ledger, f"{path}/ledger", epoch + 1)

    return outcomes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_part(buckets: int = 16) -> Column:
    """The part of the ledger in which an entity's failures lie."""
    return F.pmod(F.xxhash64(F.col("entity_id")), F.lit(buckets)).cast("string")


def create_store(log: CommitLog, items: DataFrame, ledger: DataFrame, width: int | None = None) -> Entry:
    """Stores items by ranges of ids, the ledger by entity, and no runs yet, as one commit."""
    part = id_part(width=width) if width else id_part()
    runs = run_row(items.sparkSession.createDataFrame([], "outcome string"), 0, "1970-01-01").limit(0)
    parts = {"items": log.write_parts("items", items, part), "ledger": log.write_parts("ledger", ledger, ledger_part()), "runs": {}}
    return log.commit(log.head(), parts, {"items": items.schema, "ledger": ledger.schema, "runs": runs.schema}, width=width or 0)


def apply_epoch(log: CommitLog, batch: DataFrame, epoch: int, now, name: str = "outcomes", between: Callable[[str], None] = lambda step: None) -> Entry:
    """Applies a micro-batch of the stream ``name``: touched parts of items and ledger, and a row of runs, become visible in one commit.

    The commit also notes the epoch, so a repeated one does nothing, whether its first run was lost before or after its commit.
    An epoch with too many unreadable details changes no item: only its failures and its row are kept. ``between`` is called after each write.
    """

    def attempt() -> Entry:
        base = log.head()
        if int(base.notes.get(f"epoch of {name}", -1)) >= epoch:
            return base
        run = log.write("runs", run_row(batch, epoch, now), f"{name} {epoch}")
        between("runs")
        failed = F.col("outcome").isin("error", "drift")
        rows = batch.withColumn("outcome", F.when(failed, "error").otherwise(F.col("outcome")))
        stopped = log.spark.read.parquet(f"{log.path}/{next(iter(run.values()))}").first()["status"] == "failed"
        rows = rows.where(failed) if stopped else rows
        ids = rows.select(F.col("item_id").cast("string").alias("entity_id"))
        changed = rows.where("outcome <> 'error'")
        width = int(base.notes.get("width") or 0)
        part = id_part(width=width) if width else id_part()
        ledger = lambda old: apply_outcomes(log.read("items", base, []), old, rows, now)[1]
        items = lambda old: apply_outcomes(old, log.read("ledger", base, []), changed, now)[0]
        new_items, _ = merge_parts(log, base, "items", changed, part, items)
        between("items")
        new_ledger, _ = merge_parts(log, base, "ledger", ids, ledger_part(), ledger)
        between("ledger")
        return log.commit(base, {"items": new_items, "ledger": new_ledger, "runs": run}, **{f"epoch of {name}": epoch})

    batch = batch.persist()  # read once by each table
    try:
        return retried(attempt)
    finally:
        batch.unpersist()


def stream_commits(outcomes: DataFrame, path: str, checkpoint: str, now, name: str = "outcomes", between: Callable[[int, str], None] = lambda epoch, step: None):
    """Applies a stream of outcomes to the store in ``path``, a commit for each micro-batch."""

    def apply(batch: DataFrame, epoch: int) -> None:
        apply_epoch(CommitLog(batch.sparkSession, path), batch, epoch, now, name, lambda step: between(epoch, step))

    return outcomes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
