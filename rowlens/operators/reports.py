"""Coverage, cohorts, reasons, lifts and suggestions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.config import Profile
from rowlens.functions.dates import DAY, as_timestamp
from rowlens.operators.store import Store
from rowlens.schemas import TIERS

STAGES = ("seniority", "visa", "role", "location", "tech", "compensation")


def live(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("is_active") & F.col("is_canonical"))


def coverage_totals(store: Store) -> DataFrame:
    return live(store.postings).agg(F.count_distinct("company_slug").alias("companies"), F.count(F.lit(1)).alias("postings"))


def coverage_by_sector(store: Store) -> DataFrame:
    return live(store.postings).join(store.companies.select("company_slug", "sector"), "company_slug").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def coverage_by_country(store: Store) -> DataFrame:
    places = store.locations.filter("country is not null").select("posting_id", "country").distinct()
    return live(store.postings).select("posting_id").join(places, "posting_id").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def silent_companies(store: Store, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Enabled registry companies without an active posting seen in the last ``days``."""
    seen = store.postings.filter(F.col("is_active") & (F.col("last_seen_at") >= as_timestamp(as_of) - F.expr(f"interval '{days}' day")))
    rows = store.companies.filter(F.col("enabled") & ~F.col("discovered"))
    return rows.join(seen.select("company_slug"), "company_slug", "left_anti").select("company_slug").orderBy("company_slug")


def weeks_ago(moment: Column, as_of: datetime | str) -> Column:
    """0 for the seven days before ``as_of``, 1 for those before; cohorts are anchored at ``as_of``, the younger end open."""
    seconds = F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp(moment)
    return (F.ceil(seconds / (7 * DAY)) - 1).cast("int")


def cohort_rows(store: Store, as_of: datetime | str, weeks: int) -> DataFrame:
    edge = as_timestamp(as_of)
    first = edge - F.expr(f"interval '{7 * weeks}' day")
    rows = store.postings.filter(F.col("is_canonical") & (F.col("first_seen_at") >= first) & (F.col("first_seen_at") < edge))
    return rows.withColumn("week", weeks_ago(F.col("first_seen_at"), as_of))


def resolved_flags(store: Store, rows: DataFrame) -> DataFrame:
    """A 0/1 column per stage: whether the posting's field is resolved."""
    placed = store.locations.filter("country is not null").select("posting_id").distinct().withColumn("__placed", F.lit(True))
    tagged = store.tech.select("posting_id").distinct().withColumn("__tagged", F.lit(True))
    wide = rows.join(placed, "posting_id", "left").join(tagged, "posting_id", "left")
    tests = {
        "seniority": F.col("seniority") != "unknown",
        "visa": F.col("visa_sponsorship") != "unknown",
        "role": F.col("role_family") != "other",
        "location": F.col("__placed").isNotNull(),
        "tech": F.col("__tagged").isNotNull(),
        "compensation": F.col("salary_min").isNotNull(),
    }
    return wide.select(*rows.columns, *[F.coalesce(t, F.lit(False)).cast("double").alias(f"r_{name}") for name, t in tests.items()])


def spine(spark, weeks: int) -> DataFrame:
    return spark.range(weeks).select(F.col("id").cast("int").alias("week"))


def weekly_resolution(store: Store, as_of: datetime | str, weeks: int = 4) -> DataFrame:
    """week (0 is the newest), postings and the resolution rate of every stage; weeks without postings have rates 0."""
    rates = [F.avg(f"r_{s}").alias(s) for s in STAGES]
    counted = resolved_flags(store, cohort_rows(store, as_of, weeks)).groupBy("week").agg(F.count(F.lit(1)).alias("postings"), *rates)
    filled = spine(store.postings.sparkSession, weeks).join(counted, "week", "left")
    return filled.select("week", F.coalesce("postings", F.lit(0).cast("long")).alias("postings"), *[F.coalesce(s, F.lit(0.0)).alias(s) for s in STAGES])


def tiers_by_week(store: Store, as_of: datetime | str, weeks: int = 4) -> DataFrame:
    counted = cohort_rows(store, as_of, weeks).groupBy("week").pivot("tier", list(TIERS)).count()
    return spine(store.postings.sparkSession, weeks).join(counted, "week", "left").na.fill(0, list(TIERS))


def rejection_reasons(store: Store, limit: int = 10) -> DataFrame:
    rows = store.verdicts.filter("rejection_reason is not null").join(store.postings.filter("is_canonical").select("posting_id"), "posting_id", "left_semi")
    return rows.groupBy(F.col("rejection_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def llm_load(postings: DataFrame, queue: DataFrame, tokens_per_call: int = 1600, tokens_per_s: int = 40) -> DataFrame:
    """One row: postings that the model settled, queued ones, skipped turns, and the seconds that the settled ones took."""
    done = postings.agg(F.count_if(F.col("resolver_stage") == "llm").alias("resolved"))
    waiting = queue.agg(F.count(F.lit(1)).alias("queued"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("skipped"))
    # two one-row frames side by side
    return done.join(waiting, F.lit(True)).withColumn("gpu_seconds", F.col("resolved") * tokens_per_call / tokens_per_s)


def favorites(store: Store) -> DataFrame:
    marked = store.flags.filter("is_favorite").select("posting_id")
    verdicts = store.verdicts.select("posting_id", "score", "tier", "rejection_reason")
    rows = store.postings.select("posting_id", "title", "company_slug").join(marked, "posting_id", "left_semi").join(verdicts, "posting_id")
    return rows.orderBy(F.desc("score"), "posting_id")


def lifts(favorite: DataFrame, base: DataFrame) -> DataFrame:
    """key, favorites, shares and lift of two (key, n) frames; keys that the base lacks are dropped."""
    totals = favorite.agg(F.sum("n").alias("fav_total")).join(base.agg(F.sum("n").alias("base_total")), F.lit(True))
    rows = favorite.select("key", F.col("n").alias("favorites")).join(base.select("key", F.col("n").alias("base")), "key")
    # the totals are one row
    rows = rows.join(F.broadcast(totals), F.lit(True))
    shares = rows.select("key", "favorites", (F.col("favorites") / F.col("fav_total")).alias("favorite_share"), (F.col("base") / F.col("base_total")).alias("base_share"))
    return shares.withColumn("lift", F.col("favorite_share") / F.col("base_share"))


def company_lifts(store: Store) -> DataFrame:
    marked = store.flags.filter("is_favorite").select("posting_id")
    fav = store.postings.join(marked, "posting_id", "left_semi").groupBy(F.col("company_slug").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    base = live(store.postings).groupBy(F.col("company_slug").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return lifts(fav, base)


def tech_lifts(store: Store) -> DataFrame:
    marked = store.flags.filter("is_favorite").select("posting_id")
    fav = store.tech.join(marked, "posting_id", "left_semi").groupBy(F.col("tech").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    base = store.tech.join(live(store.postings).select("posting_id"), "posting_id", "left_semi").groupBy(F.col("tech").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return lifts(fav, base)


def suggestions(store: Store, profile: Profile, least_lift: float = 2.0, least_favorites: int = 3) -> DataFrame:
    """kind, key and value: favourites outside the tiers, a low median score, and over-represented employers and tags."""
    marked = favorites(store)
    off = marked.filter("tier = 'rejected'").agg(F.lit("off_target").alias("kind"), F.lit("").alias("key"), F.count(F.lit(1)).cast("double").alias("value")).filter("value > 0")
    low = marked.agg(F.lit("median_score").alias("kind"), F.lit("").alias("key"), F.median("score").alias("value")).filter(F.col("value") < profile.tiers["possible"])
    over = [
        frame.filter((F.col("lift") >= least_lift) & (F.col("favorites") >= least_favorites)).select(F.lit(kind).alias("kind"), "key", F.col("lift").alias("value"))
        for kind, frame in (("company", company_lifts(store)), ("tech", tech_lifts(store)))
    ]
    return off.unionByName(low).unionByName(over[0]).unionByName(over[1])


def discovered_employers(store: Store) -> DataFrame:
    active = store.postings.filter("is_active").select("company_slug", "posting_id")
    rows = store.companies.filter("discovered").select("company_slug", "company_name").join(active, "company_slug", "left")
    return rows.groupBy("company_slug", "company_name").agg(F.count("posting_id").alias("n"))


def company_counts(store: Store) -> DataFrame:
    """Registry companies and their live postings, 0 where there are none."""
    n = live(store.postings).groupBy("company_slug").agg(F.count(F.lit(1)).alias("n"))
    return store.companies.filter("not discovered").select("company_slug", "company_name").join(n, "company_slug", "left").na.fill(0, ["n"])


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def funnel(store: Store, profile: Profile) -> DataFrame:
    """Six counts, each within the one before: all, live, described, unsettled, near the tiers, of first-rank employers."""
    rank = store.companies.select("company_slug", "priority")
    rows = store.postings.join(rank, "company_slug", "left").join(store.texts.select("posting_id", F.char_length("description").alias("chars")), "posting_id", "left")
    steps = [F.lit(True), F.col("is_active") & F.col("is_canonical"), F.col("chars") >= profile.llm["min_description_chars"], (F.col("seniority") == "unknown") | (F.col("visa_sponsorship") == "unknown"), F.col("score") >= profile.tiers["stretch"], F.col("priority") == 1]
    reached, out = F.lit(True), []
    for k, step in enumerate(steps):
        reached = reached & F.coalesce(step, F.lit(False))
        out.append(F.count_if(reached).alias(f"step{k}"))
    return rows.agg(*out)
