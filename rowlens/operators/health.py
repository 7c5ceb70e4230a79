"""Run-log health: alerts, breaker state, board counts and cadence, all recomputed from the log.

Runs of one source are ordered newest first by start, then run_id. Windows are
partitioned by source; a source's log is bounded by its retention, and only the
newest ``LOOKBACK`` runs of a source are kept before the windows run.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.functions.dates import as_timestamp, due
from rowlens.functions.money import back_off

LOOKBACK = 50
MUTE_RUNS, HISTORY, DROP = 3, 6, 0.2
STALE_HOURS, STALLED = 48, 3
FAILURES = ("error", "blocked")
THRESHOLD, BASE_DELAY, MAX_DELAY = 3, 30.0, 3600.0
COUNTS = ("fetched", "new", "updated", "aliased", "rejected")
#: Sources whose boards have a host each: a block there is one board's.
OWN_HOST = ("workday", "custom")


def newest(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def recent_runs(runs: DataFrame, limit: int = LOOKBACK) -> DataFrame:
    """The newest runs of every source, numbered from 1; what lies beyond is dropped before the shuffle."""
    return runs.withColumn("place", F.row_number().over(newest("source"))).filter(F.col("place") <= limit)


def attempts(runs: DataFrame) -> DataFrame:
    """Aggregate runs of every source without skipped ones, numbered from 1 at the newest."""
    rows = recent_runs(runs).filter("company_slug is null and status <> 'skipped'").drop("place")
    return rows.withColumn("place", F.row_number().over(newest("source")))


def run_alerts(runs: DataFrame) -> DataFrame:
    """source, last_run_at, last_count and alert: mute when the newest runs are all empty, volume drop against the median before, else null."""
    w = newest("source")
    before = w.rowsBetween(1, HISTORY)
    newest_few = w.rowsBetween(0, MUTE_RUNS - 1)
    rows = attempts(runs).select(
        "source", "place", F.col("started_at").alias("last_run_at"), F.col("fetched").alias("last_count"),
        F.sum(F.when(F.col("status") == "empty", 1).otherwise(0)).over(newest_few).alias("empties"),
        F.percentile(F.col("fetched"), F.lit(0.5)).over(before).alias("median"),
    ).filter("place = 1")
    mute = F.col("empties") == MUTE_RUNS
    drop = (F.col("median") > 0) & (F.col("last_count") < F.col("median") * DROP)
    return rows.select("source", "last_run_at", "last_count", F.when(mute, "source_mute").when(drop, "volume_drop").alias("alert"))


def board_counts(runs: DataFrame) -> DataFrame:
    """source, boards_ok and boards_error by every board's newest status."""
    latest = recent_runs(runs).filter("company_slug is not null").groupBy("source", "company_slug").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    return latest.groupBy("source").agg(F.count_if(F.col("status").isin("ok", "empty")).alias("boards_ok"), F.count_if(F.col("status").isin(*FAILURES)).alias("boards_error"))


def feed_health(postings: DataFrame, as_of: datetime | str, stale_hours: int = STALE_HOURS) -> DataFrame:
    """One row: live postings, age of the newest in hours, and whether the feed is stale."""
    found = postings.agg(F.count_if(F.col("is_active") & F.col("is_canonical")).alias("active"), F.max("first_seen_at").alias("newest"))
    age = (F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp("newest")) / 3600
    return found.select("active", age.alias("newest_age_h"), F.coalesce(age > stale_hours, F.lit(False)).alias("stale"))


def snapshot(companies: DataFrame, runs: DataFrame, as_of: datetime | str, interval_min: dict[str, int] | None = None) -> DataFrame:
    """source, status (ok, degraded, disabled, unknown), last run, board counts and alert, per source of the registry."""
    registry = companies.groupBy("source").agg(F.max("enabled").alias("enabled"))
    rows = registry.join(run_alerts(runs), "source", "left").join(board_counts(runs), "source", "left")
    stalled = F.lit(False)
    if interval_min:
        minutes = F.try_element_at(F.create_map(*[F.lit(x) for kv in interval_min.items() for x in kv]), F.col("source"))
        stalled = F.coalesce(F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp("last_run_at") > minutes * 60 * STALLED, F.lit(False))
    alert = F.coalesce(F.col("alert"), F.when(stalled, "source_stalled"))
    seen = F.col("last_run_at").isNotNull()
    status = F.when(~F.col("enabled"), "disabled").when(~seen, "unknown").when(alert.isNotNull(), "degraded").otherwise("ok")
    shown = F.col("enabled") & seen
    return rows.select(
        "source", status.alias("status"), F.when(shown, F.col("last_run_at")).alias("last_run_at"), F.when(shown, F.col("last_count")).alias("last_count"),
        F.coalesce("boards_ok", F.lit(0)).cast("long").alias("boards_ok"), F.coalesce("boards_error", F.lit(0)).cast("long").alias("boards_error"), F.when(shown, alert).alias("alert"),
    )


def breaker(runs: DataFrame, as_of: datetime | str, threshold: int = THRESHOLD, base: float = BASE_DELAY, most: float = MAX_DELAY) -> DataFrame:
    """source, state (closed, open, half_open), failures in a row and retry_at.

    Skipped runs are transparent; a blocked newest run trips at once, errors at
    ``threshold`` in a row; the delay doubles from ``base`` seconds to ``most``.
    """
    ok_so_far = F.sum(F.when(F.col("status").isin(*FAILURES), 0).otherwise(1)).over(newest("source"))
    rows = attempts(runs).withColumn("oks", ok_so_far)
    latest = rows.groupBy("source").agg(
        F.count_if(F.col("oks") == 0).cast("int").alias("failures"),
        F.max(F.when(F.col("place") == 1, F.col("status"))).alias("status"),
        F.max(F.when(F.col("place") == 1, F.col("ended_at"))).alias("ended_at"),
    )
    tripped = F.col("status").isin(*FAILURES) & ((F.col("status") == "blocked") | (F.col("failures") >= threshold))
    retry = F.timestamp_seconds(F.unix_timestamp("ended_at") + back_off(base, F.col("failures"), most).cast("long"))
    state = F.when(~tripped, "closed").when(as_timestamp(as_of) >= retry, "half_open").otherwise("open")
    return latest.select("source", state.alias("state"), "failures", F.when(tripped, retry).alias("retry_at"))


def due_boards(companies: DataFrame, runs: DataFrame, as_of: datetime | str) -> DataFrame:
    """Enabled boards whose turn it is, in order of priority and slug; failed attempts count as attempts."""
    last = runs.filter("company_slug is not null").groupBy("source", "company_slug").agg(F.max("started_at").alias("last_attempt"))
    rows = companies.filter("enabled").join(last, ["source", "company_slug"], "left")
    return rows.filter(due(F.col("priority"), F.col("last_attempt"), as_of)).orderBy("priority", "company_slug")


def cycle_row(boards: DataFrame) -> DataFrame:
    """source, totals and status of one cycle from its boards' runs."""
    totals = [F.sum(c).alias(c) for c in COUNTS]
    rows = boards.groupBy("source").agg(*totals, F.count_if(F.col("status") == "blocked").alias("b"), F.count_if(F.col("status").isin("ok", "empty")).alias("good"), F.count_if(F.col("status") != "skipped").alias("asked"))
    status = F.when(F.col("b") > 0, "blocked").when(F.col("asked") == 0, "skipped").when(F.col("good") == 0, "error").when(F.col("fetched") > 0, "ok").otherwise("empty")
    return rows.select("source", "fetched", "new", "updated", "aliased", "rejected", status.alias("status"))


def lot(seed: str) -> Column:
    """A board's place in the shuffled order of a cycle: the same for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(seed), "source", "company_slug"))


def plan_cycle(companies: DataFrame, runs: DataFrame, as_of: datetime | str, seed: str, force: bool = False, threshold: int = THRESHOLD, base: float = BASE_DELAY, most: float = MAX_DELAY) -> DataFrame:
    """source, company_slug, state and lot of the boards that a cycle asks, in the order of their lots.

    Sources whose breaker is open ask none; half-open ones ask the due board of the
    lowest lot. ``force`` ignores the cadence, never the breaker.
    """
    rows = companies.filter("enabled") if force else due_boards(companies, runs, as_of)
    state = breaker(runs, as_of, threshold, base, most).select("source", "state")
    rows = rows.select("source", "company_slug").join(state, "source", "left").withColumn("state", F.coalesce("state", F.lit("closed")))
    rows = rows.filter("state <> 'open'").withColumn("lot", lot(seed))
    probe = rows.filter("state = 'half_open'").groupBy("source").agg(F.min(F.struct("lot", "company_slug")).alias("first"))
    probe = probe.select("source", "first.company_slug", F.lit("half_open").alias("state"), "first.lot")
    return rows.filter("state = 'closed'").unionByName(probe)


def asked_boards(plan: DataFrame, answers: DataFrame, own_host: tuple[str, ...] = OWN_HOST) -> DataFrame:
    """The answers (source, company_slug, status, counts) of the boards that the plan reaches.

    A block ends its source's cycle after the blocked board, but for sources whose
    boards have a host each.
    """
    rows = plan.join(answers, ["source", "company_slug"])
    shared = ~F.col("source").isin(*own_host)
    wall = rows.filter(shared & (F.col("status") == "blocked")).groupBy("source").agg(F.min("lot").alias("wall"))
    return rows.join(wall, "source", "left").filter("wall is null or lot <= wall").drop("wall")


def cycle_log(companies: DataFrame, runs: DataFrame, plan: DataFrame, answers: DataFrame, as_of: datetime | str, threshold: int = THRESHOLD, base: float = BASE_DELAY, most: float = MAX_DELAY, own_host: tuple[str, ...] = OWN_HOST) -> DataFrame:
    """Run rows of one cycle: one for each board asked, and for every source of the registry one without a board.

    Blocks of sources with a host for each board don't make the source blocked. A
    source with an open breaker or without a due board is skipped.
    """
    boards = asked_boards(plan, answers, own_host).select("source", "company_slug", "status", *COUNTS)
    state = breaker(runs, as_of, threshold, base, most).select("source", "state")
    walled = (F.col("status") == "blocked") & ~F.col("source").isin(*own_host)
    totals = boards.groupBy("source").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS], F.count_if(walled).alias("walls"), F.count_if(F.col("status").isin("ok", "empty")).alias("good"))
    rows = companies.select("source").distinct().join(state, "source", "left").join(totals, "source", "left")
    status = F.when(F.coalesce("walls", F.lit(0)) > 0, "blocked").when(F.col("good").isNull(), "skipped").when(F.col("good") == 0, "error").when(F.col("fetched") > 0, "ok").otherwise("empty")
    why = F.when(F.col("state") == "open", "breaker_open")
    whole = rows.select("source", F.lit(None).cast("string").alias("company_slug"), status.alias("status"), why.alias("error_kind"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])
    return boards.select("source", "company_slug", "status", F.lit(None).cast("string").alias("error_kind"), *[F.col(c).cast("long") for c in COUNTS]).unionByName(whole)
