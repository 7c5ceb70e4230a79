"""Source payloads to raw records, with explicit schemas.

``pages`` is a frame (company_slug, company_name, token, body, fetched_at) of one
source's fetched payloads, however they were stored. A body that has not the
source's shape gives no record and is listed by ``malformed``; records without
their required fields are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.text import blank_to_null, content_hash, first_filled, place_in_path

_NAMED = "struct<name:string>"
#: JSON schema of a page and the path of its list of records.
SHAPES = {
    "greenhouse": (f"struct<jobs:array<struct<id:string,title:string,absolute_url:string,content:string,updated_at:string,location:{_NAMED},departments:array<{_NAMED}>>>>", "jobs"),
    "ashby": (
        "struct<jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,department:string,team:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string,isListed:boolean>>>",
        "jobs",
    ),
    "lever": (
        "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,descriptionPlain:string,description:string,openingPlain:string,opening:string,createdAt:string,categories:struct<location:string,team:string,department:string>>>",
        "",
    ),
    "recruitee": (
        "struct<offers:array<struct<id:string,title:string,careers_apply_url:string,careers_url:string,country:string,description:string,department:string,published_at:string,locations:array<struct<name:string,city:string>>>>>",
        "offers",
    ),
    "smartrecruiters": ("struct<content:array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<fullLocation:string>,department:struct<label:string>>>,totalFound:int>", "content"),
    "workable": (
        "struct<jobs:array<struct<title:string,shortcode:string,url:string,shortlink:string,city:string,state:string,country:string,description:string,department:string,published_on:string,created_at:string>>>",
        "jobs",
    ),
    "workday": ("struct<total:int,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>>", "jobPostings"),
    "adzuna": (
        "struct<results:array<struct<id:string,title:string,redirect_url:string,description:string,created:string,location:struct<display_name:string>,company:struct<display_name:string>,category:struct<label:string>>>>",
        "results",
    ),
    "efinancialcareers": (
        "struct<data:array<struct<id:string,title:string,detailsPageUrl:string,companyName:string,description:string,summary:string,postedDate:string,jobLocation:struct<displayName:string>>>>",
        "data",
    ),
}


class SchemaChanged(RuntimeError):
    """A payload that no longer has its source's shape."""


def _parsed(pages: DataFrame, source: str) -> tuple[DataFrame, Column]:
    schema, path = SHAPES[source]
    rows = pages.withColumn("page", F.from_json("body", schema))
    return rows, F.col(f"page.{path}") if path else F.col("page")


def malformed(pages: DataFrame, source: str) -> DataFrame:
    """Pages whose body has no list of records."""
    rows, found = _parsed(pages, source)
    return rows.filter(found.isNull()).select(*pages.columns)


def checked(pages: DataFrame, source: str) -> DataFrame:
    """The pages, or SchemaChanged if any is malformed."""
    bad = malformed(pages, source).select("company_slug").limit(1).collect()
    if bad:
        raise SchemaChanged(f"{source}: unexpected payload of {bad[0]['company_slug']}")
    return pages


def _fields(source: str) -> dict[str, Column]:
    def c(path: str) -> Column:
        return F.col(f"j.{path}")

    if source == "greenhouse":
        return {"id": c("id"), "title": c("title"), "url": c("absolute_url"), "description": c("content"), "location": c("location.name"), "department": F.get(c("departments"), 0)["name"], "posted": c("updated_at")}
    if source == "ashby":
        return {
            "id": c("id"), "title": c("title"), "url": first_filled(c("jobUrl"), c("applyUrl")), "description": first_filled(c("descriptionPlain"), c("descriptionHtml")), "location": c("location"),
            "department": first_filled(c("department"), c("team")), "posted": c("publishedAt"), "listed": F.coalesce(c("isListed"), F.lit(True)),
        }
    if source == "lever":
        return {
            "id": c("id"), "title": c("text"), "url": first_filled(c("hostedUrl"), c("applyUrl")), "description": first_filled(c("descriptionPlain"), c("description"), c("openingPlain"), c("opening")),
            "location": c("categories.location"), "department": first_filled(c("categories.team"), c("categories.department")), "posted": c("createdAt"),
        }
    if source == "recruitee":
        named = F.array_join(F.filter(F.transform(c("locations"), lambda x: first_filled(x["name"], x["city"])), lambda n: n.isNotNull()), "; ")
        return {"id": c("id"), "title": c("title"), "url": first_filled(c("careers_apply_url"), c("careers_url")), "description": c("description"), "location": first_filled(named, c("country")), "department": c("department"), "posted": c("published_at")}
    if source == "smartrecruiters":
        return {"id": c("id"), "title": c("name"), "url": c("ref"), "description": F.lit(""), "location": c("location.fullLocation"), "department": c("department.label"), "posted": c("releasedDate")}
    if source == "workable":
        place = F.array_join(F.filter(F.array(*[blank_to_null(c(x)) for x in ("city", "state", "country")]), lambda p: p.isNotNull()), ", ")
        return {"id": c("shortcode"), "title": c("title"), "url": first_filled(c("url"), c("shortlink")), "description": c("description"), "location": place, "department": c("department"), "posted": first_filled(c("published_on"), c("created_at"))}
    if source == "workday":
        return {"id": c("externalPath"), "title": c("title"), "url": c("externalPath"), "description": F.lit(""), "location": c("locationsText"), "department": F.lit(None).cast("string"), "posted": c("postedOn")}
    if source == "adzuna":
        return {"id": c("id"), "title": c("title"), "url": c("redirect_url"), "description": c("description"), "location": c("location.display_name"), "department": c("category.label"), "posted": c("created"), "company": c("company.display_name")}
    if source == "efinancialcareers":
        return {"id": c("id"), "title": c("title"), "url": c("detailsPageUrl"), "description": first_filled(c("description"), c("summary")), "location": c("jobLocation.displayName"), "department": F.lit(None).cast("string"), "posted": c("postedDate"), "company": c("companyName")}
    raise ValueError(f"no JSON shape for {source}")


def _raw(rows: DataFrame, source: str, f: dict[str, Column], payload: Column) -> DataFrame:
    kept = rows.filter(blank_to_null(f["id"]).isNotNull() & blank_to_null(f["title"]).isNotNull() & blank_to_null(f["url"]).isNotNull() & f.get("listed", F.lit(True)))
    description, location = F.coalesce(f["description"], F.lit("")), blank_to_null(f["location"])
    return kept.select(
        F.lit(source).alias("source"), "company_slug", f["id"].alias("source_job_id"), f["url"].alias("url"), f["title"].alias("title_raw"), description.alias("description_raw"), location.alias("location_raw"),
        blank_to_null(f["department"]).alias("department_raw"), f["posted"].alias("posted_at_raw"), F.coalesce(f.get("company", F.lit(None).cast("string")), F.col("company_name")).alias("company_name"), payload.alias("payload"), "fetched_at",
        content_hash(f["title"], description, location).alias("content_hash"),
    )


def records(pages: DataFrame, source: str) -> DataFrame:
    """Raw records of a JSON source's pages; of records repeated over pages one stays."""
    rows, found = _parsed(pages, source)
    rows = rows.select(*pages.columns, F.explode(found).alias("j"))
    return _raw(rows, source, _fields(source), F.to_json("j")).dropDuplicates(["source", "company_slug", "source_job_id"])


def personio(pages: DataFrame) -> DataFrame:
    """Raw records of XML pages: one ``position`` element each; descriptions are joined name over value."""
    schema = "id string, name string, office string, department string, createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
    every = F.regexp_extract_all("body", F.lit(r"(?s)(<position\b.*?</position>)"), F.lit(1))
    rows = pages.select(*pages.columns, F.explode(every).alias("xml")).withColumn("j", F.from_xml("xml", schema, {"rowTag": "position"}))
    filled = F.filter("j.jobDescriptions.jobDescription", lambda d: F.trim(F.coalesce(d["value"], F.lit(""))) != "")
    text = F.array_join(F.transform(filled, lambda d: F.concat_ws("\n", blank_to_null(d["name"]), d["value"])), "\n\n")
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(".jobs.personio.de/job/"), F.col("j.id"))
    fields = {"id": F.col("j.id"), "title": F.col("j.name"), "url": url, "description": F.coalesce(text, F.lit("")), "location": F.col("j.office"), "department": F.col("j.department"), "posted": F.col("j.createdAt")}
    return _raw(rows, "personio", fields, F.col("xml"))


def with_details(raw: DataFrame, details: DataFrame) -> DataFrame:
    """Descriptions of a source that lists without them; details: company_slug, source_job_id, sections (array of texts), url."""
    text = F.array_join(F.filter("sections", lambda s: blank_to_null(s).isNotNull()), "\n\n")
    more = details.select("company_slug", "source_job_id", text.alias("__text"), F.col("url").alias("__url"))
    rows = raw.join(more, ["company_slug", "source_job_id"], "left")
    rows = rows.withColumn("description_raw", F.coalesce("__text", "description_raw")).withColumn("url", F.coalesce("__url", "url")).drop("__text", "__url")
    return rows.withColumn("content_hash", content_hash(F.col("title_raw"), F.col("description_raw"), F.col("location_raw"))).select(*raw.columns)


def workday_places(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """"3 Locations" replaced by the detail's places (company_slug, source_job_id, places), else by the place in the path."""
    counted = F.coalesce(F.col("location_raw"), F.lit("")).rlike(r"^\d+ Locations?$")
    rows = raw if details is None else raw.join(details.select("company_slug", "source_job_id", "places"), ["company_slug", "source_job_id"], "left")
    told = F.lit(None).cast("string") if details is None else blank_to_null(F.array_join("places", "; "))
    rows = rows.withColumn("location_raw", F.when(counted, F.coalesce(told, place_in_path(F.col("source_job_id")), F.col("location_raw"))).otherwise(F.col("location_raw")))
    return rows.withColumn("content_hash", content_hash(F.col("title_raw"), F.col("description_raw"), F.col("location_raw"))).select(*raw.columns)


def known_descriptions(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listing with the description stored for the same record and listing hash, null where a detail must be fetched."""
    cached = known.select("company_slug", "source_job_id", "summary_hash", F.col("description").alias("__known"))
    rows = listing.withColumn("summary_hash", content_hash(F.col("title_raw"), F.lit(""), F.col("location_raw")))
    return rows.join(cached, ["company_slug", "source_job_id", "summary_hash"], "left").withColumn("description_raw", F.col("__known")).drop("__known")


def dig(body: Column, path: str) -> Column:
    """Texts at a dotted path of a JSON text: names, list positions and ``key=value`` filters; lists on the way are walked."""
    steps = [] if path == "." else path.split(".")
    now = F.array(F.try_parse_json(body))

    for step in steps:
        key, _, wanted = step.partition("=")
        flat = F.flatten(F.transform(now, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
        if step.isdigit():
            now = _element(now, int(step))
        elif wanted:
            now = _where(flat, key, wanted)
        else:
            now = _member(flat, step)
    flat = F.flatten(F.transform(now, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.filter(F.transform(flat, lambda v: F.try_variant_get(v, "$", "string")), lambda t: t.isNotNull())


def _element(values: Column, at: int) -> Column:
    return F.filter(F.transform(values, lambda v: F.try_variant_get(v, f"$[{at}]", "variant")), lambda v: v.isNotNull())


def _member(values: Column, key: str) -> Column:
    return F.filter(F.transform(values, lambda v: F.try_variant_get(v, f"$['{key}']", "variant")), lambda v: v.isNotNull())


def _where(values: Column, key: str, wanted: str) -> Column:
    return F.filter(values, lambda v: F.coalesce(F.try_variant_get(v, f"$['{key}']", "string") == wanted, F.lit(False)))


def joined_fields(body: Column, paths: tuple[str, ...], separator: str = ", ") -> Column:
    """Texts at several paths, repeats dropped."""
    texts = F.flatten(F.array(*[dig(body, p) for p in paths]))
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")), separator)


def custom_endpoint(pages: DataFrame, items: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Raw records of an endpoint described by paths: ``items`` to the list, ``fields`` (id, title, url, description, location, department, posted) inside an item."""
    schema = "array<string>"
    found = F.from_json(F.get_json_object("body", "$" if items == "." else f"$.{items}"), schema)
    rows = pages.select(*pages.columns, F.explode(found).alias("item"))
    f = {k: joined_fields(F.col("item"), fields[k]) if k in fields else F.lit(None).cast("string") for k in ("id", "title", "url", "description", "location", "department", "posted")}
    return _raw(rows, "custom", f, F.col("item")).dropDuplicates(["source", "company_slug", "source_job_id"])


def is_complete(found: DataFrame, declared: DataFrame, least: float = 0.9) -> DataFrame:
    """company_slug, n, total and truncated: whether far fewer records came than a listing (company_slug, total) declares."""
    n = found.groupBy("company_slug").agg(F.count(F.lit(1)).alias("n"))
    rows = declared.join(n, "company_slug", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("company_slug", "n", "total", (F.col("n") < least * F.col("total")).alias("truncated"))


# What pages shown instead of a listing say.
CHALLENGES = (
    "awswafcookiedomainlist", "gokuprops", "human verification", "just a moment", "cf-chl", "cf_chl_opt", "px-captcha", "are you a robot", "unusual traffic", "verify you are human",
    "enable javascript and cookies to continue",
)


def is_challenge(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 6000))
    found = F.lit(False)
    for m in CHALLENGES:
        found = found | head.contains(m)
    return found


def error_kind(status: Column) -> Column:
    """What an HTTP status means for a run: null is fine."""
    return F.when(status == 404, "board_not_found").when(status == 429, "rate_limited").when(status.isin(401, 403), "blocked").when(status >= 500, "source_down").when(status >= 400, "bad_request")


def resolve_employers(raw: DataFrame, companies: DataFrame) -> DataFrame:
    """Employers of aggregator records by normal name against registry names, then slugs; unknown ones get a slug of their own."""
    from rowlens.functions.text import employer_slug, normal_name

    names = companies.select(normal_name(F.col("company_name")).alias("key"), F.col("company_slug").alias("slug"), F.lit(0).alias("rank"))
    slugs = companies.select(normal_name(F.replace("company_slug", F.lit("_"), F.lit(" "))).alias("key"), F.col("company_slug").alias("slug"), F.lit(1).alias("rank"))
    index = names.unionByName(slugs).filter("key <> ''").groupBy("key").agg(F.min_by("slug", F.struct("rank", "slug")).alias("slug"))
    rows = raw.withColumn("key", normal_name(F.col("company_name"))).join(index, "key", "left")
    return rows.withColumn("company_slug", F.coalesce("slug", employer_slug(F.col("company_name")))).drop("key", "slug")
