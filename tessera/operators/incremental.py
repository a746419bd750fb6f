"""Rules of incremental runs: where a scan stops, where it resumes, what is retried, and how a run is judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import retry_delay_seconds
from .filters import any_seen_since
from .scans import RANGES, in_ranges, running
from .scoring import ntz

MOST_FAILURES = 3
BACKTRACK = 50
DRIFT_DETAILS = 5
COUNTERS = ("pages_checked", "failed_pages", "items_seen", "new_items", "changed_items", "details_fetched", "missing_items", "failed_details", "drift_errors")


def scan_cutoff(pages: DataFrame, stable: int = 3, max_pages: int | None = None, ranges: int = RANGES) -> DataFrame:
    """One row (cutoff, reason) for ``pages`` (page, has_new, failed, last_page), a table of pages, not of items.

    A scan stops after ``stable`` consecutive successful pages without new items (failed pages neither count nor reset),
    after three failed pages in a row, at the last page known from the latest successful one, or after ``max_pages``.
    """
    ok, new = ~F.col("failed"), ~F.col("failed") & F.col("has_new")
    p = in_ranges(pages, "page", ranges)
    p = running(p, "page", {"_quiet": (ok & ~F.col("has_new")).cast("int"), "_failed": F.col("failed").cast("int")}, {"_known": F.when(ok, F.struct("page", "last_page"))})
    # running counts never fall, so the count at the latest page with new items is the largest of those at such pages
    p = running(p, "page", maxima={"_quiet_at_new": F.when(new, F.col("_quiet")), "_failed_at_ok": F.when(ok, F.col("_failed"))})
    p = p.withColumn("_last", F.col("_known.last_page"))
    p = p.withColumn("_stable", F.col("_quiet") - F.coalesce("_quiet_at_new", F.lit(0))).withColumn("_fails", F.col("_failed") - F.coalesce("_failed_at_ok", F.lit(0)))
    reason = (
        F.when(ok & (F.col("_stable") >= stable), "stable")
        .when(F.col("failed") & (F.col("_fails") >= MOST_FAILURES), "failures")
        .when(F.lit(max_pages is not None) & (F.col("page") >= F.lit(max_pages or 0)), "max_pages")
        .when(F.col("page") >= F.col("_last"), "last_page")
    )
    stops = p.withColumn("_reason", reason)
    return stops.agg(
        F.coalesce(F.min(F.when(F.col("_reason").isNotNull(), F.col("page"))), F.max("page")).alias("cutoff"),
        F.coalesce(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("page"))), F.lit("end")).alias("reason"),
    )


def resume_page(pages: DataFrame, items: DataFrame, round_started, checkpoint: int, target: int, overlap: int = 1) -> DataFrame:
    """One row (page): where a full pass resumes, for ``pages`` (page, item_id).

    From the checkpoint it steps back, at most 50 pages, until a page holds an item seen since the pass began.
    """
    start = 1 if not checkpoint or (target and checkpoint >= target) else max(1, checkpoint + 1 - overlap)
    near = any_seen_since(pages.where((F.col("page") <= start) & (F.col("page") >= start - BACKTRACK)), items, round_started)
    return near.agg(F.coalesce(F.max(F.when(F.col("overlaps"), F.col("page"))), F.lit(max(1, start - BACKTRACK))).cast("long").alias("page"))


def contiguous_checkpoint(pages: DataFrame) -> DataFrame:
    """One row (checkpoint): the highest page before the first failed one, 0 if there is none."""
    gap = pages.agg(F.min(F.when(F.col("failed"), F.col("page"))).alias("_gap"))
    clean = pages.join(F.broadcast(gap)).where(F.col("_gap").isNull() | (F.col("page") < F.col("_gap")))  # one row
    return clean.agg(F.coalesce(F.max("page"), F.lit(0)).cast("long").alias("checkpoint"))


KEY = ["entity_type", "entity_id", "operation"]


def merge_failures(ledger: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The ledger with the failures of ``batch`` (key, url, error_type, error_message, seq); each counts as an attempt."""
    new = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max_by(F.struct("url", "error_type", F.substring("error_message", 1, 2000).alias("error_message")), "seq").alias("x"))
    joined = ledger.alias("o").join(new.alias("b"), KEY, "full_outer")
    hit, at = F.col("b.n").isNotNull(), ntz(now)
    attempts = (F.coalesce("o.attempts", F.lit(0)) + F.coalesce("b.n", F.lit(0))).cast("int")
    retry = at + F.make_dt_interval(secs=retry_delay_seconds(attempts).cast("decimal(18,6)"))
    return joined.select(
        *KEY, *(F.when(hit, F.col(f"b.x.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("url", "error_type", "error_message")), attempts.alias("attempts"),
        F.when(hit, at).otherwise(F.col("o.last_failed_at")).alias("last_failed_at"), F.when(hit, retry).otherwise(F.col("o.next_retry_at")).alias("next_retry_at"),
    )


def clear_failures(ledger: DataFrame, done: DataFrame) -> DataFrame:
    return ledger.join(done.select(*KEY).distinct(), KEY, "left_anti")


def retry_due(ledger: DataFrame, now, cap: int = 6) -> DataFrame:
    """(item_id, last_failed_at) of item details that are due and below the cap, newest failure first."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= ntz(now))
    mine = (F.col("entity_type") == "item") & (F.col("operation") == "detail") & F.col("entity_id").rlike("^[0-9]+$")
    return ledger.where(mine & (F.col("attempts") < cap) & due).select(F.col("entity_id").cast("long").alias("item_id"), "last_failed_at").orderBy(F.col("last_failed_at").desc(), "item_id")


def missing_details(items: DataFrame) -> DataFrame:
    return items.where((F.col("status") == "active") & F.col("detail_fetched_at").isNull()).select("item_id").orderBy(F.col("item_id").desc())


def stale_details(items: DataFrame, now, window_days: int = 30, refresh_after_hours: int = 72, limit: int = 500) -> DataFrame:
    """Recently published items whose details are old, oldest details first."""
    at = ntz(now)
    old = F.col("detail_fetched_at") < at - F.make_dt_interval(hours=F.lit(refresh_after_hours))
    recent = F.col("published_at") >= F.date_sub(at.cast("date"), window_days).cast("timestamp_ntz")
    return items.where((F.col("status") == "active") & old & recent).orderBy("detail_fetched_at", "item_id").limit(limit).select("item_id", "detail_fetched_at")


def work_queue(parts: dict[str, DataFrame], seen: DataFrame | None = None) -> DataFrame:
    """(item_id, reason) of the union of work lists, each item once under the first list that names it."""
    out = None
    for k, (reason, df) in enumerate(parts.items()):
        part = df.select("item_id", F.struct(F.lit(k).alias("k"), F.lit(reason).alias("reason")).alias("r"))
        out = part if out is None else out.unionByName(part)
    queue = out.groupBy("item_id").agg(F.min("r").alias("r")).select("item_id", "r.reason")
    return queue if seen is None else queue.join(seen.select("item_id").distinct(), "item_id", "left_anti")


def quality_gate(pages: DataFrame, details: DataFrame) -> DataFrame:
    """One row: (bad_pages, bad_details, stop). ``pages`` (page, last_page, n_items), ``details`` (outcome).

    An empty page that is the first or not the last is drift; so are five details that can't be parsed.
    """
    bad_page = (F.col("n_items") == 0) & ((F.col("page") == 1) | (F.col("page") < F.col("last_page")))
    a = pages.agg(F.count_if(bad_page).alias("bad_pages"))
    b = details.agg(F.count_if(F.col("outcome") == "drift").alias("bad_details"))
    return a.join(F.broadcast(b)).withColumn("stop", (F.col("bad_pages") > 0) | (F.col("bad_details") >= DRIFT_DETAILS))  # one row each


def run_summary(events: DataFrame) -> DataFrame:
    """Counters of every run from ``events`` (run_id, event), and whether it was clean, partial or failed."""
    counts = events.groupBy("run_id").agg(*(F.count_if(F.col("event") == c).alias(c) for c in COUNTERS))
    dirty = (F.col("failed_pages") > 0) | (F.col("failed_details") > 0)
    return counts.withColumn("status", F.when(F.col("drift_errors") > 0, "failed").when(dirty, "partial").otherwise("success"))


def needs_full_refresh(summary: DataFrame) -> Column:
    """Whether a run changed anything; if not, only recent hot scores are refreshed."""
    return sum((F.col(c) for c in ("new_items", "changed_items", "details_fetched", "missing_items")), F.lit(0)) > 0


def close_runs(runs: DataFrame, summary: DataFrame, now) -> DataFrame:
    """Closes running runs: with a summary by its counters, without one, unless it is the newest run, as abandoned."""
    newest = runs.agg(F.max("run_id").alias("_newest"))
    joined = runs.alias("o").join(summary.alias("s"), "run_id", "left").join(F.broadcast(newest))  # one row
    running, done = F.col("o.status") == "running", F.col("s.status").isNotNull()
    orphan = running & ~done & (F.col("run_id") < F.col("_newest"))
    return joined.select(
        "run_id", F.when(running & done, F.col("s.status")).when(orphan, "failed").otherwise(F.col("o.status")).alias("status"), F.col("o.started_at"),
        F.when((running & done) | orphan, ntz(now)).otherwise(F.col("o.finished_at")).alias("finished_at"),
        F.when(orphan, F.coalesce("o.error", F.lit("abandoned"))).otherwise(F.col("o.error")).alias("error"),
        *(F.col(f"s.{c}").alias(c) for c in COUNTERS),
    )
