"""Scoring: hard rejects, contributions, verdicts, tracks and the prefilter of what a reader should see.

Everything is one projection: no shuffle, no Python. ``rows`` hold a posting per
row with arrays ``locations`` and ``tech`` and the employer's ``sector`` and ``rank``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.config import Profile
from rowlens.functions.dates import age_days, reference_date
from rowlens.functions.text import word_keyword
from rowlens.schemas import REASON

EU = ("AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE")


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def in_countries(countries: tuple[str, ...]) -> Column:
    return F.exists("locations", lambda x: _yes(x["country"].isin(*countries)))


def in_scope(profile: Profile) -> Column:
    """Out of scope is no rejection: the profile does not score the posting at all."""
    return in_countries(profile.scope_countries) if profile.scope_countries else F.lit(True)


def on_topic(profile: Profile) -> Column:
    if profile.topic_titles is None:
        return F.lit(True)
    return _yes(F.arrays_overlap("tech", _strings(profile.topic_tech))) | word_keyword(F.col("title"), profile.topic_titles)


def age(as_of: datetime | str) -> Column:
    return age_days(reference_date(F.col("posted_at"), F.col("first_seen_at")), as_of)


def hard_reject(profile: Profile, as_of: datetime | str) -> Column:
    """The first reason that applies, else null."""
    title = F.col("title")
    steps = [
        (word_keyword(title, profile.excluded), "excluded_title"),
        (F.col("role_family") == "other", "not_quant" if profile.topic_titles is None else "off_topic"),
        (_yes(F.col("sector").isin(*profile.exclude_sectors)) if profile.exclude_sectors else F.lit(False), "off_topic"),
        (~on_topic(profile), "off_topic"),
        (_yes(F.col("min_years") > profile.min_years_above) | word_keyword(title, profile.reject_words), "senior_only"),
        (F.col("phd_required") & profile.phd_rejects, "phd_required"),
        (age(as_of) > profile.stale_after_days, "stale"),
    ]
    return F.coalesce(*[F.when(test, reason) for test, reason in steps])


def contributions(profile: Profile, as_of: datetime | str) -> Column:
    """array<struct<code, delta, evidence>> of what counts, in a fixed order."""
    title, tech, days = F.col("title"), F.col("tech"), age(as_of)
    strong, possible = word_keyword(title, profile.strong), word_keyword(title, profile.possible)
    niche = F.array_sort(F.array_intersect(tech, _strings(profile.niche_tech)))
    early = F.col("seniority").isin("graduate", "junior", "intern") | _yes(F.col("min_years") <= profile.years_max)
    none, age_text = F.lit(None).cast("string"), F.concat(F.lit("age_days="), days.cast("string"))
    table = [
        ("title_strong", strong, title),
        ("title_possible", ~strong & possible, title),
        ("sector_tier1", F.col("rank") == 1, none),
        ("seniority_match", early, F.concat(F.lit("min_years="), F.col("min_years").cast("string"))),
        ("graduate_programme", F.col("seniority") == "graduate", none),
        ("tech_cpp", F.array_contains(tech, "cpp"), F.lit("cpp")),
        ("tech_python", F.array_contains(tech, "python"), F.lit("python")),
        ("tech_niche", F.size(niche) > 0, F.array_join(niche, ", ")),
        ("visa_sponsors", F.col("visa_sponsorship") == "sponsors", F.col("visa_evidence")),
        ("visa_no", F.col("visa_sponsorship") == "no", F.col("visa_evidence")),
        ("freshness_7d", days <= profile.window_days, age_text),
        ("salary_disclosed", F.col("salary_min").isNotNull(), F.col("salary_raw")),
        ("stale_penalty", days > profile.stale_after_days * profile.stale_fraction, age_text),
    ]
    found = [
        F.when(_yes(test), F.struct(F.lit(code).alias("code"), F.lit(profile.weights[code]).alias("delta"), evidence.cast("string").alias("evidence")).cast(REASON))
        for code, test, evidence in table
    ]
    return F.array_compact(F.array(*found))


def tier_of(score: Column, profile: Profile) -> Column:
    t = profile.tiers
    return F.when(score >= t["strong"], "strong").when(score >= t["possible"], "possible").when(score >= t["stretch"], "stretch").otherwise("rejected")


def evaluate(rows: DataFrame, profile: Profile, as_of: datetime | str) -> DataFrame:
    """rows with score, tier, reasons and rejection_reason; a rejected row always has a reason, no other one has."""
    found = rows.withColumn("__reject", hard_reject(profile, as_of)).withColumn("__found", contributions(profile, as_of))
    total = F.aggregate("__found", F.lit(0), lambda acc, r: acc + r["delta"])
    out = F.col("__reject").isNotNull()
    found = found.withColumn("score", F.when(out, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))))
    found = found.withColumn("tier", F.when(out, "rejected").otherwise(tier_of(F.col("score"), profile)))
    found = found.withColumn("reasons", F.when(out, F.expr(f"cast(array() as array<{REASON}>)")).otherwise(F.col("__found")))
    found = found.withColumn("rejection_reason", F.coalesce("__reject", F.when(F.col("tier") == "rejected", "low_score")))
    return found.withColumn("profile_version", F.lit(profile.version)).drop("__reject", "__found")


def score_tracks(rows: DataFrame, tracks: dict[str, Profile], existing: DataFrame, as_of: datetime | str) -> DataFrame:
    """Verdicts of all tracks: those still current stay, missing, outdated and older ones are made anew, those out of scope or of unknown tracks go.

    ``rows`` carry ``scored_at`` of the main verdict; ``existing`` is (track, posting_id, score, tier, rejection_reason, profile_version, scored_at).
    """
    made = None
    columns = ["track", "posting_id", "score", "tier", "rejection_reason", "profile_version", "scored_at"]
    for name, profile in tracks.items():
        inside = rows.filter(in_scope(profile))
        old = existing.filter(F.col("track") == name)
        known = old.select("posting_id", F.col("profile_version").alias("old_version"), F.col("scored_at").alias("old_at"))
        dated = inside.withColumnRenamed("scored_at", "main_at").join(known, "posting_id", "left")
        stale = F.col("old_version").isNull() | (F.col("old_version") != profile.version) | (F.col("old_at") < F.col("main_at"))
        fresh = evaluate(dated.filter(stale).drop("score", "tier", "rejection_reason", "profile_version"), profile, as_of)
        fresh = fresh.select(F.lit(name).alias("track"), "posting_id", "score", "tier", "rejection_reason", "profile_version", F.lit(as_of).cast("timestamp").alias("scored_at"))
        kept = old.join(dated.filter(~stale).select("posting_id"), "posting_id", "left_semi").select(*columns)
        both = fresh.unionByName(kept)
        made = both if made is None else made.unionByName(both)
    return made if made is not None else existing.filter(F.lit(False)).select(*columns)


def is_ambiguous(profile: Profile) -> Column:
    """Whether reading the posting could change its verdict; needs description, score, tier and rejection_reason. Screens out only what is certain."""
    reason = F.col("rejection_reason")
    reviewable = _yes(reason == "not_quant") & _yes(F.col("rank") == 1)
    final = reason.isNotNull() & ~reviewable
    short = _yes(F.char_length("description") < profile.llm["min_description_chars"]) | F.col("description").isNull()
    settled = (
        (F.col("tier") != "rejected")
        & (F.col("seniority") != "unknown")
        & (F.col("visa_sponsorship") != "unknown")
        & (F.col("score") >= profile.tiers["strong"] + profile.llm["high_confidence_margin"])
    )
    open_visa = (F.col("visa_sponsorship") == "unknown") & ~in_countries(EU)
    return F.when(final | short, False).when(reviewable, True).when(settled, False).otherwise((F.col("seniority") == "unknown") | open_visa)


def is_urgent(profile: Profile) -> Column:
    near = (F.col("tier") != "rejected") & (F.col("score") >= profile.tiers["possible"])
    return _yes(F.col("rank") == 1) & (_yes(F.col("rejection_reason") == "not_quant") | near)
