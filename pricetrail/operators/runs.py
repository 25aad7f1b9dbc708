"""Sync runs: status, freshness and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours after which a source is stale, a run is dead, a refresh is due.
MAX_AGE_HOURS, RUN_DEADLINE_HOURS, REFRESH_HOURS = 26, 12, 24
# Counters that make a run partial, and those that spoil a price refresh.
PARTIAL_COUNTERS = ("errors", "ageRestrictedPages", "searchPromotionConflicts", "skuErrors", "skuUnavailable", "skuConflicts")
REFRESH_COUNTERS = ("errors", "ageRestrictedPages", "ageRestrictedCards", "searchPromotionConflicts")
FAILED = ("partial", "failed", "interrupted")


def _any_positive(names: tuple[str, ...], available: list[str]) -> Column:
    test = F.lit(False)
    for name in names:
        if name in available:
            test = test | (F.coalesce(F.col(name), F.lit(0)) > 0)
    return test


def run_status(stats: DataFrame) -> DataFrame:
    """Status and price_refresh_complete of runs with their summed counters and scope."""
    partial = _any_positive(PARTIAL_COUNTERS, stats.columns)
    spoiled = _any_positive(REFRESH_COUNTERS, stats.columns)
    complete = (F.col("scope") == "full") & (F.coalesce("categoriesProcessed", F.lit(0)) > 0) & ~spoiled
    return stats.withColumns({"status": F.when(partial, "partial").otherwise("complete"), "price_refresh_complete": complete})


def close_stale_runs(runs: DataFrame, at: Column) -> DataFrame:
    """Runs still running when a new one starts were interrupted."""
    stale = F.col("status") == "running"
    return runs.withColumns({
        "finished_at": F.when(stale, at).otherwise(F.col("finished_at")),
        "status": F.when(stale, "interrupted").otherwise(F.col("status")),
    })


def last_complete(runs: DataFrame, kind: str) -> DataFrame:
    """End of the last complete run per type."""
    return runs.filter("status = 'complete'").groupBy(kind).agg(F.max("finished_at").alias("finished_at"))


def recent(history: DataFrame, limit: int = 40, key: str = "id") -> DataFrame:
    return history.orderBy(F.desc(key)).limit(limit)


def _hours(at: Column, since: Column) -> Column:
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(3_600_000_000)


def latest_runs(runs: DataFrame, source: str = "source") -> DataFrame:
    """Per source: the latest full-scope attempt and the start of the latest complete price refresh.

    A run seen both while it runs and after it ended counts as ended.
    """
    ended = (F.col("status") != "running").alias("ended")
    attempt = F.max_by(F.struct("started_at", "id", ended, "status", "source_error"), F.struct("started_at", "id", ended))
    full = runs.filter("scope = 'full'")
    return full.groupBy(source).agg(
        attempt.alias("attempt"), F.max(F.when(F.col("price_refresh_complete"), F.col("started_at"))).alias("checked_at"))


def describe(latest: DataFrame, at: Column, source: str = "source") -> DataFrame:
    """fresh, stale, unknown, error or running, from latest_runs."""
    checked, attempt = F.col("checked_at"), F.col("attempt")
    verified = (
        F.when(checked.isNull() | (checked > at), "unknown")
        .when(_hours(at, checked) <= MAX_AGE_HOURS, "fresh").otherwise("stale"))
    alive = _hours(at, attempt["started_at"]) <= RUN_DEADLINE_HOURS
    status = (
        F.when(attempt["status"].isin(*FAILED), "error")
        .when(attempt["status"] == "running", F.when(alive, "running").otherwise("error"))
        .otherwise(verified))
    return latest.select(
        source, status.alias("status"), checked.alias("last_successful_check_at"), attempt["started_at"].alias("last_attempt_at"),
        attempt["status"].alias("last_attempt_status"), attempt["source_error"].alias("error_code"))


def freshness(runs: DataFrame, at: Column, source: str = "source") -> DataFrame:
    return describe(latest_runs(runs, source), at, source)


def is_due(at: Column) -> Column:
    """Whether a refresh should start, over freshness columns."""
    checked = F.col("last_successful_check_at")
    bad = F.col("status").isin("error", "stale", "unknown")
    return checked.isNull() | bad | (checked > at) | (_hours(at, checked) >= REFRESH_HOURS)


def warning(at: Column) -> Column:
    """What a consumer is warned of, over freshness columns."""
    checked = F.col("last_successful_check_at")
    return (
        F.when(F.coalesce(F.col("error_code") == "access_denied", F.lit(False)), "access_denied")
        .when(F.col("status") == "error", "error")
        .when(checked.isNull(), "unconfirmed")
        .when((checked > at) | (_hours(at, checked) > MAX_AGE_HOURS), "stale")
        .when(F.col("status") == "running", "running")
        .otherwise("none"))
