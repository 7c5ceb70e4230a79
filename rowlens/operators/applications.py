"""Applications: history, lifecycle, statistics, views, writes and CV registry."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.functions.dates import months_after
from rowlens.functions.text import fold

WAITING = ("applied", "interview")
ABANDONED_MONTHS = 5
STATUS_RANK = {"offer": 0, "interview": 1, "applied": 2, "rejected": 3, "withdrawn": 4}


def with_lifecycle(apps: DataFrame, events: DataFrame, today: date | str) -> DataFrame:
    """Adds last_news, reached_interview, is_abandoned and is_open; derived, never stored."""
    history = events.groupBy("application_id").agg(F.max("on_date").alias("__last"), F.max(F.col("status") == "interview").alias("__met"))
    rows = apps.join(history, "application_id", "left")
    news = F.coalesce("__last", "applied_on")
    waiting = F.col("status").isin(*WAITING)
    abandoned = waiting & F.coalesce(months_after(news, ABANDONED_MONTHS) < F.lit(today).cast("date"), F.lit(False))
    rows = rows.withColumn("last_news", news).withColumn("reached_interview", (F.col("status") == "interview") | F.coalesce("__met", F.lit(False)))
    return rows.withColumn("is_abandoned", abandoned).withColumn("is_open", waiting & ~abandoned).drop("__last", "__met")


def answer_delay(today: date | str) -> Column:
    """Days from applying to the answer, or to today while waiting."""
    until = F.when(F.col("closed_on").isNotNull(), F.col("closed_on")).when(F.col("status").isin(*WAITING), F.lit(today).cast("date"))
    return F.datediff(until, F.col("applied_on"))


def response_rate() -> Column:
    return F.avg((F.col("status") != "applied").cast("double"))


def stats(rows: DataFrame) -> DataFrame:
    """One row of counts, the share that got any answer, and the median days to a rejection."""
    days = F.when(F.col("status") == "rejected", F.datediff("closed_on", "applied_on"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_open").alias("open"), F.count_if("is_abandoned").alias("abandoned"), F.count_if("reached_interview").alias("interviews"),
        F.count_if(F.col("status") == "offer").alias("offers"), F.count_if(F.col("status") == "rejected").alias("rejected"), response_rate().alias("response_rate"), F.median(days).alias("median_days"),
    )


def cv_stats(rows: DataFrame) -> DataFrame:
    """Per CV that was sent: how often, how often only by inference, interviews and response rate."""
    sent = rows.filter("cv_id is not null").groupBy("cv_id")
    return sent.agg(F.count(F.lit(1)).alias("sent"), F.count_if("cv_inferred").alias("inferred"), F.count_if("reached_interview").alias("interviews"), response_rate().alias("response_rate"))


def country_counts(rows: DataFrame) -> DataFrame:
    """country and n of rows with an array ``countries``."""
    return rows.select("application_id", F.explode(F.array_distinct("countries")).alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country")


def years(rows: DataFrame) -> DataFrame:
    return rows.select(F.year("applied_on").alias("year")).filter("year is not null").distinct().orderBy(F.desc("year"))


VIEWS = {
    "all": lambda: F.lit(True),
    "open": lambda: F.col("is_open"),
    "interviews": lambda: F.col("reached_interview"),
    "offers": lambda: F.col("status") == "offer",
    "rejected": lambda: F.col("status") == "rejected",
    "abandoned": lambda: F.col("is_abandoned"),
}


def view(rows: DataFrame, name: str = "all", year: int | None = None, country: str | None = None, without_cv: bool = False, text: str | None = None) -> DataFrame:
    """Rows with lifecycle that a view shows; ``text`` is looked for without case and accents."""
    found = rows.filter(VIEWS[name]())
    if year is not None:
        found = found.filter(F.year("applied_on") == year)
    if country is not None:
        found = found.filter(F.array_contains("countries", country))
    if without_cv:
        found = found.filter("cv_id is null")
    if text:
        found = found.filter(fold(F.concat_ws(" ", "company", "title")).contains(fold(F.lit(text))))
    return found


def listing(rows: DataFrame, open_only: bool = False, status: str | None = None, company: str | None = None, limit: int | None = None) -> DataFrame:
    """Latest first, undated last, then company and id; ``company`` is any part of the name, case aside."""
    kept = rows.filter("is_open") if open_only else rows
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    if company:
        kept = kept.filter(F.contains(F.lower("company"), F.lower(F.lit(company))))
    ordered = kept.orderBy(F.desc_nulls_last("applied_on"), "company", "application_id")
    return ordered if limit is None else ordered.limit(limit)


def sorted_view(rows: DataFrame, by: str, today: date | str, descending: bool = False) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STATUS_RANK.items()], F.lit(len(STATUS_RANK)))
    key = {"applied": F.col("applied_on"), "company": F.lower("company"), "status": rank, "delay": answer_delay(today)}[by]
    keys = [key, F.col("application_id")]
    return rows.orderBy(*[k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys])


def with_history(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the events in order."""
    history = events.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("seq", "on_date", "status"))).alias("events"))
    return rows.join(history, "application_id", "left")


def latest_per_posting(apps: DataFrame) -> DataFrame:
    w = Window.partitionBy("posting_id").orderBy(F.desc("application_id"))
    return apps.filter("posting_id is not null").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_status(events: DataFrame) -> DataFrame:
    """application_id, number of steps and the newest status."""
    return events.groupBy("application_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("status", "seq").alias("status"))


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """New (application_id, on_date, status, order) behind those that are there, numbered on."""
    last = events.groupBy("application_id").agg((F.max("seq") + 1).alias("__next"))
    w = Window.partitionBy("application_id").orderBy("order")
    rows = new.join(last, "application_id", "left")
    rows = rows.select("application_id", (F.coalesce("__next", F.lit(0)) + F.row_number().over(w) - 1).cast("int").alias("seq"), "on_date", "status")
    return events.select("application_id", "seq", "on_date", "status").unionByName(rows)


def set_status(apps: DataFrame, events: DataFrame) -> DataFrame:
    """Applications with the newest status of their history."""
    now = latest_status(events).select("application_id", F.col("status").alias("__status"))
    rows = apps.join(now, "application_id", "left")
    return rows.select(*[F.coalesce("__status", "status").alias("status") if c == "status" else c for c in apps.columns])


def mirror_status(flags: DataFrame, apps: DataFrame) -> DataFrame:
    """Marks with the newest application's status; other marks stay as they are."""
    now = latest_per_posting(apps).select("posting_id", F.col("status").alias("__status"))
    rows = flags.join(now, "posting_id", "full")
    return rows.select(*[F.coalesce("__status", "application_status").alias("application_status") if c == "application_status" else c for c in flags.columns])


def unlinked_marks(flags: DataFrame, apps: DataFrame) -> DataFrame:
    """Marks with a status that no application stands behind."""
    return flags.filter("application_status is not null").join(apps.filter("posting_id is not null").select("posting_id"), "posting_id", "left_anti")


def track_postings(apps: DataFrame, events: DataFrame, wishes: DataFrame, links: DataFrame, today: date | str, cv_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(applications, events) after postings got a status, or lost it (null).

    wishes: posting_id, status, company, company_slug, title, location, one row a posting; links:
    posting_id and the application_id of a recorded application that has no posting yet.
    An application with that posting is the newest one; else a linked one takes the posting;
    else a new one of origin ``feed`` is made, applied today, with the CV in use. A lost
    status deletes what the feed made and unlinks what was recorded otherwise.
    """
    day = F.lit(today).cast("date")
    own = latest_per_posting(apps).select("posting_id", F.col("application_id").alias("own_id"), "origin", F.col("status").alias("old"))
    linked = links.groupBy("posting_id").agg(F.min("application_id").alias("linked_id"))
    free = apps.filter("posting_id is null").select(F.col("application_id").alias("linked_id"), F.col("status").alias("linked_old"))
    asked = wishes.join(own, "posting_id", "left").join(linked.join(free, "linked_id"), "posting_id", "left")
    known = F.coalesce("own_id", F.when(F.col("status").isNotNull(), F.col("linked_id")))
    made_id = F.substring(F.sha2(F.concat_ws("\x1f", "posting_id", day.cast("string")), 256), 1, 26)
    asked = asked.select(
        *wishes.columns, F.coalesce(known, made_id).alias("application_id"), known.isNull().alias("is_new"), F.coalesce("old", "linked_old").alias("before"),
        (F.col("status").isNull() & (F.col("origin") == "feed")).alias("deletes"),
    ).filter("status is not null or not is_new")
    closing = F.when(F.col("status").isin("rejected", "withdrawn"), day)
    fields = {
        "application_id": F.col("application_id"), "posting_id": F.col("posting_id"), "status": F.col("status"), "company": F.col("company"), "company_slug": F.col("company_slug"), "title": F.col("title"),
        "location": F.col("location"), "applied_on": day, "closed_on": closing, "origin": F.lit("feed"), "cv_id": F.lit(cv_id).cast("string"), "cv_inferred": F.lit(cv_id is not None),
    }
    new = asked.filter("is_new").select(*[fields.get(c, F.lit(None)).cast(apps.schema[c].dataType).alias(c) for c in apps.columns])
    change = asked.filter("not is_new").select("application_id", F.col("posting_id").alias("__posting"), F.col("status").alias("__status"), "deletes", F.lit(True).alias("__hit"))
    rows = apps.join(change, "application_id", "left").filter(~F.coalesce("deletes", F.lit(False)))
    moved = {
        "posting_id": F.when(F.col("__hit"), F.when(F.col("__status").isNotNull(), F.col("__posting"))).otherwise(F.col("posting_id")),
        "status": F.coalesce("__status", "status"),
    }
    if "closed_on" in apps.columns:
        closed = F.when(F.col("__status").isin("rejected", "withdrawn"), F.coalesce("closed_on", day)).otherwise(F.col("closed_on"))
        moved["closed_on"] = F.when(F.col("__status").isNull() | (F.col("__status") == F.col("status")), F.col("closed_on")).otherwise(closed)
    after = rows.select(*[moved.get(c, F.col(c)).alias(c) for c in apps.columns]).unionByName(new)
    # a new application begins as applied, and every change of status is news
    steps = asked.filter("status is not null").select("application_id", "status", "is_new", "before")
    first = steps.filter("is_new").select("application_id", day.alias("on_date"), F.lit("applied").alias("status"), F.lit(0).alias("order"))
    then = steps.filter((F.col("is_new") & (F.col("status") != "applied")) | (~F.col("is_new") & ~F.col("status").eqNullSafe(F.col("before"))))
    history = append_events(events, first.unionByName(then.select("application_id", day.alias("on_date"), "status", F.lit(1).alias("order"))))
    gone = change.filter("deletes").select("application_id")
    return after, history.join(gone, "application_id", "left_anti")


def import_history(apps: DataFrame, produced: DataFrame, touched: DataFrame) -> DataFrame:
    """Imported rows replaced by the newly produced ones, where the user touched none; imports no longer produced go, all others stay."""
    keep = apps.join(touched.select("application_id"), "application_id", "left_semi")
    own = apps.filter("origin <> 'import'").join(touched.select("application_id"), "application_id", "left_anti")
    fresh = produced.join(touched.select("application_id"), "application_id", "left_anti")
    return keep.unionByName(own).unionByName(fresh.select(*apps.columns))


def cv_registry(cvs: DataFrame, new: DataFrame) -> DataFrame:
    """cv_id, label, pinned, created_at: known ids keep their label, pinned is never taken back."""
    both = cvs.select("cv_id", "label", "pinned", "created_at", F.lit(0).alias("__new")).unionByName(new.select("cv_id", "label", "pinned", "created_at", F.lit(1).alias("__new")))
    return both.groupBy("cv_id").agg(F.min_by("label", "__new").alias("label"), F.max("pinned").alias("pinned"), F.min_by("created_at", "__new").alias("created_at"))


def current_cv(cvs: DataFrame, apps: DataFrame) -> DataFrame:
    """CVs with their number of applications, the most recently used or made first."""
    used = apps.groupBy("cv_id").agg(F.count(F.lit(1)).alias("sent"), F.max("applied_on").alias("last"))
    rows = cvs.join(used, "cv_id", "left").withColumn("sent", F.coalesce("sent", F.lit(0).cast("long")))
    return rows.orderBy(F.greatest(F.col("last").cast("timestamp"), F.col("created_at")).desc_nulls_last(), "cv_id")


def backfill_cvs(apps: DataFrame, candidates: DataFrame) -> DataFrame:
    """application_id with the only CV of its folder, or the candidates where there are several (ambiguous); candidates: (dossier, cv_id)."""
    found = candidates.groupBy("dossier").agg(F.array_sort(F.collect_set("cv_id")).alias("ids"))
    rows = apps.filter("cv_id is null and dossier is not null").join(found, "dossier")
    return rows.select("application_id", F.when(F.size("ids") == 1, F.get("ids", 0)).alias("cv_id"), F.when(F.size("ids") > 1, F.col("ids")).alias("ambiguous"))
