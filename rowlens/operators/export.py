"""Flat exports and the weekly report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.text import location_label
from rowlens.operators import reports
from rowlens.operators.feed import DEFAULT_FILTER, PostingFilter, base_feed, order
from rowlens.operators.store import Store


def flat_feed(store: Store, flt: PostingFilter = DEFAULT_FILTER, sort: str = "score", as_of: datetime | str | None = None) -> DataFrame:
    """One text row per posting in feed order, places and tags joined."""
    rows = base_feed(store, flt, as_of)
    places = store.locations.groupBy("posting_id").agg(F.array_join(F.array_sort(F.collect_set(location_label(F.col("city"), F.col("country"), F.col("remote_mode")))), "; ").alias("locations"))
    tags = store.tech.groupBy("posting_id").agg(F.array_join(F.array_sort(F.collect_set("tech")), ", ").alias("tech"))
    wide = rows.join(places, "posting_id", "left").join(tags, "posting_id", "left").orderBy(*order(sort))
    return wide.select(
        "posting_id", "title", "company_name", "sector", "locations", F.col("eff_tier").alias("tier"), F.col("eff_score").alias("score"), "role_family", "seniority", "min_years", "visa_sponsorship",
        "tech", F.col("salary_min").cast("string").alias("salary_min"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), "application_status", "url",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A report with one object a line, nested fields as they are."""
    rows.write.mode("overwrite").json(path)


def weekly_report(store: Store, queue: DataFrame, as_of: datetime | str) -> dict[str, DataFrame]:
    """The report's sections by name."""
    return {
        "coverage": reports.coverage_totals(store), "sectors": reports.coverage_by_sector(store), "countries": reports.coverage_by_country(store), "silent": reports.silent_companies(store, as_of),
        "resolution": reports.weekly_resolution(store, as_of), "tiers": reports.tiers_by_week(store, as_of), "reasons": reports.rejection_reasons(store),
        "llm": reports.llm_load(store.postings, queue), "discovered": reports.discovered_employers(store), "company_lifts": reports.company_lifts(store), "tech_lifts": reports.tech_lifts(store),
    }
