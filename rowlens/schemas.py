"""Value sets and explicit schemas of the frames; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The persisted value sets of each enumerated column.
SOURCES = (
    "greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "personio",
    "workday", "custom", "efinancialcareers", "wttj", "linkedin", "indeed", "adzuna",
)
AGGREGATORS = ("efinancialcareers", "wttj", "linkedin", "indeed", "adzuna")
ROLE_FAMILIES = ("quant_dev", "quant_research", "quant_trading", "swe_platform", "data_eng", "risk", "other")
SENIORITIES = ("intern", "graduate", "junior", "mid", "senior", "lead", "unknown")
VISA = ("sponsors", "no", "unknown")
REMOTE_MODES = ("onsite", "hybrid", "remote", "unknown")
PERIODS = ("year", "month", "day", "hour")
TIERS = ("strong", "possible", "stretch", "rejected")
REJECTIONS = ("excluded_title", "not_quant", "off_topic", "senior_only", "phd_required", "stale", "low_score")
STATUSES = ("applied", "interview", "offer", "rejected", "withdrawn")
RUN_STATUSES = ("ok", "empty", "error", "blocked", "skipped")
OUTCOMES = ("corrected", "confirmed", "set_aside")

MONEY = T.DecimalType(18, 4)

LOCATION = "struct<city:string,country:string,region:string,remote_mode:string,raw:string>"
COMPENSATION = (
    "struct<amount_min:decimal(18,4),amount_max:decimal(18,4),currency:string,period:string,"
    "bonus_mentioned:boolean,equity_mentioned:boolean,raw:string>"
)
REASON = "struct<code:string,delta:int,evidence:string>"

#: A record as a source gives it.
RAW = (
    "source string, company_slug string, source_job_id string, url string, title_raw string, description_raw string, "
    "location_raw string, department_raw string, posted_at_raw string, company_name string, payload string, fetched_at timestamp, content_hash string"
)
RUN = (
    "run_id string, source string, company_slug string, started_at timestamp, ended_at timestamp, fetched int, new int, updated int, "
    "aliased int, rejected int, requests_made int, status string, error_kind string"
)
APPLICATION = (
    "application_id string, company string, company_slug string, title string, location string, applied_on date, "
    "applied_on_estimated boolean, closed_on date, status string, reason string, posting_id string, dossier string, origin string"
)
EVENT = "application_id string, seq int, on_date date, status string, reason string"


def names(schema: str) -> list[str]:
    """Column names of a flat schema string."""
    return [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip()]
