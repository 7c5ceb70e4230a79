"""Retention: what stays after payloads, postings and runs have aged out. Deleting is keeping the rest: one filter or anti join each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.dates import as_timestamp
from rowlens.operators.store import Store

PAYLOAD_DAYS, NOT_QUANT_DAYS, INACTIVE_DAYS, RUN_DAYS = 365, 90, 180, 90


def _before(column: str, as_of: datetime | str, days: int):
    return F.col(column) < as_timestamp(as_of) - F.expr(f"interval '{days}' day")


def kept_payloads(payloads: DataFrame, verdicts: DataFrame, as_of: datetime | str) -> DataFrame:
    """Payloads inside their window; those of postings rejected as not_quant have the shorter one."""
    reasons = verdicts.select("posting_id", "rejection_reason")
    rows = payloads.join(reasons, "posting_id", "left")
    short = F.coalesce(F.col("rejection_reason") == "not_quant", F.lit(False))
    old = (short & _before("fetched_at", as_of, NOT_QUANT_DAYS)) | (~short & _before("fetched_at", as_of, PAYLOAD_DAYS))
    return rows.filter(~old).select(*payloads.columns)


def kept_postings(postings: DataFrame, flags: DataFrame, applications: DataFrame, as_of: datetime | str) -> DataFrame:
    """Postings but those inactive for long that the user neither marked nor applied to."""
    by_user = flags.select("posting_id").unionByName(applications.filter("posting_id is not null").select("posting_id")).distinct().withColumn("__user", F.lit(True))
    rows = postings.join(by_user, "posting_id", "left")
    old = ~F.col("is_active") & _before("last_seen_at", as_of, INACTIVE_DAYS) & F.col("__user").isNull()
    return rows.filter(~old).select(*postings.columns)


def kept_runs(runs: DataFrame, as_of: datetime | str) -> DataFrame:
    return runs.filter(~_before("started_at", as_of, RUN_DAYS))


def run_retention(store: Store, payloads: DataFrame, runs: DataFrame, applications: DataFrame, as_of: datetime | str) -> tuple[Store, DataFrame, DataFrame]:
    """Store, payloads and runs after retention; child rows and payloads of postings that go, go with them."""
    postings = kept_postings(store.postings, store.flags, applications, as_of)
    ids = postings.select("posting_id")

    def only(df: DataFrame) -> DataFrame:
        return df.join(ids, "posting_id", "left_semi")

    left = store.with_(postings=postings, locations=only(store.locations), tech=only(store.tech), verdicts=only(store.verdicts), track_verdicts=only(store.track_verdicts))
    return left, only(kept_payloads(payloads, store.verdicts, as_of)), kept_runs(runs, as_of)


def keep_newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows (backups, snapshots)."""
    return rows.orderBy(F.desc(by)).limit(n)
