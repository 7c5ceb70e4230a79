"""Entity resolution of histories kept by hand: spreadsheet rows, folders and feed postings.

Candidates come from equi joins on the employer's key and a day block; evidence
is an expression; the greedy assignment runs in rounds of windows and joins over ids
and points (``matching``), so no employer's pairs meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.places import place_agreement, places, single_place_words
from rowlens.operators.matching import linked, one_to_one
from rowlens.session import cut_lineage
from rowlens.functions.text import SEP, company_key, fold, name_leftover, once, title_tokens

#: Least points of a pair and of a shared folder; days between posting and application; days beyond which a date excludes a pair.
LEAST, SHARED, LINK_DAYS, FAR_DAYS = 1, 4, 4, 31


def date_evidence(left: Column, right: Column) -> Column:
    """4 within two days, 3 within ten, 1 within a month; null (impossible) beyond, 0 where a date is missing."""
    gap = F.abs(F.datediff(left, right))
    return F.when(gap.isNull(), 0).when(gap <= 2, 4).when(gap <= 10, 3).when(gap <= FAR_DAYS, 1)


def title_evidence(left: Column, right: Column) -> Column:
    """Two points a shared token, six at most; -2 where both have tokens and share none."""
    n = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0).when(n > 0, F.least(2 * n, F.lit(6))).otherwise(-2)


def keyed(df: DataFrame, company: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumn("folded_company", fold(F.coalesce(F.col(company), F.lit("")))).withColumn("company_key", company_key(F.col("folded_company"), aliases))


def candidate_pairs(rows: DataFrame, folders: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """company_key, row_id, folder_id, points and the row's twin key of pairs with evidence.

    rows: row_id, company, title, location, applied_on, closed_on, reason; folders:
    folder_id, company, title (of the folder's name), day.
    """
    left = keyed(rows, "company", aliases)
    twin = F.sha2(F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("company", "title", "location", "applied_on", "closed_on", "reason")]), 256)
    # tokens and places are read once a row; only a row without a title needs the pair, for what its employer's name has more
    title, where = fold(F.coalesce("title", F.lit(""))), fold(F.coalesce("location", F.lit("")))
    left = left.select("company_key", "row_id", "applied_on", twin.alias("twin"), F.col("folded_company").alias("row_company"), title.alias("row_title"), where.alias("row_location"))
    left = left.withColumn("row_tokens", title_tokens(F.col("row_title"), single_place_words())).withColumn("row_places", places(F.col("row_location")))
    right = keyed(folders, "company", aliases)
    right = right.select("company_key", "folder_id", "day", F.col("folded_company").alias("folder_company"), title.alias("folder_title"))
    right = right.withColumn("folder_tokens", title_tokens(F.col("folder_title"), single_place_words())).withColumn("folder_places", places(F.col("folder_title")))
    # pairs meet in a block of days, or because one side has no date; impossible ones never do
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / FAR_DAYS).cast("string")
    near = F.array(*[F.floor(F.datediff("applied_on", F.lit("1970-01-01").cast("date")) / FAR_DAYS + k).cast("string") for k in (-1, 0, 1)], F.lit("undated folder"))
    left = left.withColumn("block", F.explode(F.when(F.col("applied_on").isNotNull(), near).otherwise(F.array(F.lit("undated row")))))
    right = right.withColumn("block", F.explode(F.when(F.col("day").isNotNull(), F.array(block("day"), F.lit("undated row"))).otherwise(F.array(F.lit("undated row"), F.lit("undated folder")))))
    both = left.join(right, ["company_key", "block"])
    leftover = title_tokens(name_leftover(F.col("row_company"), F.col("folder_company")), single_place_words())
    # a name has nothing more than itself
    hint = F.when((F.col("row_title") != "") | (F.col("row_company") == F.col("folder_company")), F.col("row_tokens")).otherwise(leftover)
    agree = F.coalesce(place_agreement(F.col("row_places"), F.col("folder_places")), F.lit(0))
    points = date_evidence(F.col("applied_on"), F.col("day")) + once(hint, lambda h: title_evidence(h, F.col("folder_tokens"))) + agree
    return both.select("company_key", "row_id", "folder_id", "twin", points.cast("int").alias("points")).filter(F.col("points") >= LEAST)


def assign(pairs: DataFrame) -> DataFrame:
    """company_key, row_id, folder_id, outcome and candidates: greedy one-to-one assignment, best evidence first.

    outcome is paired, shared (the folder is another row's) or ambiguous: a tie
    between folders that the row's twins don't explain is reported, never guessed.
    """
    pairs = cut_lineage(pairs)
    paired, tied = one_to_one(pairs)
    none, some = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    found = paired.select("row_id", "folder_id", F.lit("paired").alias("outcome"), some.alias("candidates"))
    found = found.unionByName(tied.select("row_id", none.alias("folder_id"), F.lit("ambiguous").alias("outcome"), "candidates"))
    strong = pairs.filter(F.col("points") >= SHARED).join(paired.select("folder_id"), "folder_id", "left_semi").join(found.select("row_id"), "row_id", "left_anti")
    shared = strong.groupBy("row_id").agg(F.count_distinct("folder_id").alias("n"), F.min("folder_id").alias("folder_id")).filter("n = 1")
    found = found.unionByName(shared.select("row_id", "folder_id", F.lit("shared").alias("outcome"), some.alias("candidates")))
    return found.join(pairs.select("company_key", "row_id").distinct(), "row_id").select("company_key", "row_id", "folder_id", "outcome", "candidates")


STILL_OPEN = ("", "waiting", "waiting for answer", "?")


def history(reason: Column, applied_on: Column, closed_on: Column) -> Column:
    """struct(status, events) of a spreadsheet row: a rejection after a failed interview has that interview in its history."""
    said = F.lower(F.trim(reason))
    waiting = (said == "waiting for answer") | (said.isin(*STILL_OPEN) & closed_on.isNull())
    step = "struct<on_date:date,status:string,reason:string>"

    def event(day: Column, status: str, why: Column) -> Column:
        return F.struct(day.alias("on_date"), F.lit(status).alias("status"), why.cast("string").alias("reason")).cast(step)

    none = F.lit(None)
    applied, rejected = event(applied_on, "applied", none), event(closed_on, "rejected", reason)
    met = event(none.cast("date"), "interview", none)
    failed = said.rlike("(?i)failed.*interview|interview.*failed")
    events = F.when(waiting, F.array(applied)).when(failed, F.array(applied, met, rejected)).otherwise(F.array(applied, rejected))
    return F.struct(F.when(waiting, "applied").otherwise("rejected").alias("status"), events.alias("events"))


def application_id(folded_company: Column, folded_title: Column, day: Column, occurrence: Column) -> Column:
    """Id by the name as written, so that a new alias changes nothing."""
    parts = [F.lit("import"), F.trim(folded_company), F.trim(F.coalesce(folded_title, F.lit(""))), F.coalesce(day.cast("string"), F.lit("")), occurrence.cast("string")]
    return F.substring(F.sha2(F.concat_ws(SEP, *parts), 256), 1, 26)


def reconcile(rows: DataFrame, folders: DataFrame, registry: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Applications from both histories, with ``paired``, ``shared``, ``ambiguous``, ``sheet_only`` or ``folder_only`` as ``outcome``.

    registry: company_key, company_slug; employers it lacks keep a null slug.
    """
    found = assign(candidate_pairs(rows, folders, aliases))
    sheet = keyed(rows, "company", aliases).join(found.select("row_id", "folder_id", "outcome", "candidates"), "row_id", "left")
    names = folders.select("folder_id", F.col("title").alias("folder_title"), "day", "estimated", "relative")
    sheet = sheet.join(names, "folder_id", "left")
    told = history(F.coalesce("reason", F.lit("")), F.col("applied_on"), F.col("closed_on"))
    day = F.coalesce("applied_on", "day")
    out = sheet.select(
        "company_key", "company", F.coalesce("title", "folder_title").alias("title"), "location", day.alias("applied_on"), (F.col("applied_on").isNull() & F.coalesce("estimated", F.lit(False))).alias("applied_on_estimated"),
        "closed_on", told["status"].alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.col("relative").alias("dossier"), told["events"].alias("events"),
        F.coalesce("outcome", F.lit("sheet_only")).alias("outcome"), "candidates",
    )
    lone = keyed(folders, "company", aliases).join(found.filter("folder_id is not null").select("folder_id").distinct(), "folder_id", "left_anti")
    none = F.lit(None)
    rest = lone.select(
        "company_key", "company", "title", none.cast("string").alias("location"), F.col("day").alias("applied_on"), F.col("estimated").alias("applied_on_estimated"), none.cast("date").alias("closed_on"),
        F.lit("applied").alias("status"), F.lit("").alias("reason"), F.col("relative").alias("dossier"),
        F.array(F.struct(F.col("day").alias("on_date"), F.lit("applied").alias("status"), none.cast("string").alias("reason"))).alias("events"), F.lit("folder_only").alias("outcome"), none.cast("array<string>").alias("candidates"),
    )
    every = out.unionByName(rest).join(registry.select("company_key", "company_slug").dropDuplicates(["company_key"]), "company_key", "left")
    from pyspark.sql import Window

    every = every.withColumn("__c", fold(F.col("company"))).withColumn("__t", fold(F.coalesce("title", F.lit(""))))
    same = Window.partitionBy("__c", "__t", "applied_on").orderBy("outcome", F.coalesce("dossier", F.lit("")), "status")
    every = every.withColumn("__n", F.row_number().over(same) - 1)
    return every.withColumn("application_id", application_id(F.col("__c"), F.col("__t"), F.col("applied_on"), F.col("__n"))).drop("__c", "__t", "__n")


def link_candidates(postings: DataFrame, applications: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """company_key, posting_id, application_id, twin and points of one employer's pairs at most four days apart.

    postings: posting_id, company_slug, company_name, title, places, day; applications
    without a posting: application_id, company, company_slug, title, location, applied_on, status, reason.
    """
    twin = F.sha2(F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("company", "title", "location", "applied_on", "status", "reason")]), 256)
    apps = keyed(applications.filter("posting_id is null and applied_on is not null"), "company", aliases)
    apps = apps.select("application_id", "applied_on", twin.alias("twin"), F.array_distinct(F.array_compact(F.array("company_slug", "company_key"))).alias("keys"), title_tokens(fold(F.coalesce("title", F.lit(""))), single_place_words()).alias("app_title"), places(fold(F.coalesce("location", F.lit("")))).alias("app_places"))
    feed = keyed(postings, "company_name", aliases)
    feed = feed.select("posting_id", "day", F.array_distinct(F.array("company_slug", "company_key")).alias("keys"), title_tokens(fold(F.col("title")), single_place_words()).alias("post_title"), places(fold(F.coalesce("places", F.lit("")))).alias("post_places"))

    # the band of days is an equi join too: an application meets the day blocks it can lie in
    block = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / (2 * LINK_DAYS + 1))
    reach = F.datediff("applied_on", F.lit("1970-01-01").cast("date"))
    width = 2 * LINK_DAYS + 1
    left = feed.withColumn("key", F.explode("keys")).withColumn("block", block).drop("keys")
    right = apps.withColumn("key", F.explode("keys")).withColumn("block", F.explode(F.array_distinct(F.array(F.floor((reach - LINK_DAYS) / width), F.floor((reach + LINK_DAYS) / width))))).drop("keys")
    both = left.join(right, ["key", "block"]).filter(F.abs(F.datediff("applied_on", "day")) <= LINK_DAYS)
    points = title_evidence(F.col("post_title"), F.col("app_title")) + F.coalesce(place_agreement(F.col("post_places"), F.col("app_places")), F.lit(0))
    scored = both.select("key", "posting_id", "application_id", "twin", points.cast("int").alias("points")).filter("points >= 0")
    return scored.groupBy("posting_id", "application_id").agg(F.min("key").alias("company_key"), F.first("twin").alias("twin"), F.max("points").alias("points"))


def link_postings(candidates: DataFrame) -> DataFrame:
    """posting_id with its application_id, or with the tied ones as ``ambiguous``; twins are no tie."""
    done, torn = linked(candidates)
    none = F.lit(None)
    return done.select("posting_id", "application_id", none.cast("array<string>").alias("ambiguous")).unionByName(torn.select("posting_id", none.cast("string").alias("application_id"), "ambiguous"))
