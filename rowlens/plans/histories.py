"""Queries over histories kept by hand: which row belongs to which folder, and which posting to which application."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from rowlens.config import build_geo
from rowlens.functions import places
from rowlens.operators import resolve
from rowlens.operators.text_index import GramIndex
from rowlens.plans.projection import canonical
from rowlens.plans.registry import query
from rowlens.session import shared_folder

#: Tokens of the titles of ``sheet`` and ``folders``, and the place in a title.
_TOKENS = """case when {0} like 'Software Engineer%' then ['sw', 'eng'] when {0} like 'Data Engineer%' then ['data', 'eng'] when {0} like 'Quant Developer%' then ['quant', 'dev']
    when {0} like 'Risk Analyst%' then ['risk', 'analyst'] else [] end"""
_PLACE = "case when {0} like '%London' then 'London' when {0} like '%Paris' then 'Paris' when {0} like '%Chicago' then 'Chicago' end"
_TITLE_POINTS = "case when len({0}) = 0 or len({1}) = 0 then 0 when len(list_intersect({0}, {1})) > 0 then least(6, 2 * len(list_intersect({0}, {1}))) else -2 end"
#: London and Paris lie in one region, Chicago in another one.
_PLACE_POINTS = "case when {0} is null or {1} is null then 0 when {0} = {1} then 3 when 'Chicago' in ({0}, {1}) then -3 else -1 end"

_PAIRS = f""", left_rows as (select *, {_TOKENS.format("title")} as tokens, concat_ws('|', company, coalesce(title, '-'), coalesce(location, '-'), coalesce(applied_on::varchar, '-'), reason) as twin from sheet),
    right_rows as (select *, {_TOKENS.format("title")} as tokens, {_PLACE.format("title")} as place from folders),
    scored as (select l.company as company_key, row_id, folder_id, twin, case when applied_on is null or day is null then 0 when abs(applied_on - day) <= 2 then 4 when abs(applied_on - day) <= 10 then 3 when abs(applied_on - day) <= 31 then 1 end
        + {_TITLE_POINTS.format("l.tokens", "r.tokens")} + {_PLACE_POINTS.format("l.location", "r.place")} as points from left_rows l join right_rows r using (company)),
    pairs as (select * from scored where points >= 1)"""

#: One pair after the other, all employers side by side; a step knows what earlier ones took.
_GREEDY = """, ordered as (select *, row_number() over (partition by company_key order by points desc, row_id, folder_id) as i,
        list_sort(list_filter(list(folder_id) over (partition by row_id, points), lambda x: x <> folder_id)) as rivals from pairs),
    alike as (select company_key, twin, list(distinct row_id) as twins from pairs group by all),
    steps as (
        select company_key, 0::bigint as i, []::varchar[] as used_rows, []::varchar[] as used, []::varchar[] as tied, []::varchar[] as choices from (select distinct company_key from pairs)
        union all
        select company_key, i, case when takes then list_append(used_rows, row_id) else used_rows end, case when takes then list_append(used, folder_id) else used end,
            case when comes and not takes then list_append(tied, row_id) else tied end, case when comes and not takes then list_append(choices, array_to_string(list_sort(list_append(free, folder_id)), ',')) else choices end
        from (select *, comes and len(list_filter(twins, lambda x: x <> row_id and not list_contains(used_rows, x) and not list_contains(tied, x))) >= len(free) as takes from (
            select s.company_key, o.i, s.used_rows, s.used, s.tied, s.choices, o.row_id, o.folder_id, a.twins, list_filter(o.rivals, lambda x: not list_contains(s.used, x)) as free,
                not (list_contains(s.used_rows, o.row_id) or list_contains(s.tied, o.row_id) or list_contains(s.used, o.folder_id)) as comes
            from steps s join ordered o on o.company_key = s.company_key and o.i = s.i + 1 join alike a on a.company_key = o.company_key and a.twin = o.twin))),
    ends as (select * from steps qualify row_number() over (partition by company_key order by i desc) = 1),
    paired as (select company_key, unnest(used_rows) as row_id, unnest(used) as folder_id from ends),
    torn as (select company_key, unnest(tied) as row_id, unnest(choices) as candidates from ends),
    shared as (select company_key, row_id, min(folder_id) as folder_id from pairs where points >= 4 and folder_id in (select folder_id from paired) and row_id not in (select row_id from paired) and row_id not in (select row_id from torn)
        group by all having count(distinct folder_id) = 1)
    select company_key, row_id, folder_id, 'paired' as outcome, null as candidates from paired union all select company_key, row_id, null, 'ambiguous', candidates from torn
    union all select company_key, row_id, folder_id, 'shared', null from shared"""




@query(_PAIRS + " select company_key, row_id, folder_id, points from pairs", "sheet", "folders")
def row_folder_pairs(spark, sf):
    """Pairs of spreadsheet rows and folders of one employer with evidence for each other."""
    found = resolve.candidate_pairs(canonical(spark, sf, "sheet"), canonical(spark, sf, "folders"))
    return found.select("company_key", "row_id", "folder_id", "points")


@query(_PAIRS + _GREEDY, "sheet", "folders")
def assigned_folders(spark, sf):
    """Which folder each spreadsheet row belongs to."""
    found = resolve.assign(resolve.candidate_pairs(canonical(spark, sf, "sheet"), canonical(spark, sf, "folders")))
    return found.withColumn("candidates", F.array_join("candidates", ","))


_LINKS = f""", apps as (select row_id as application_id, company, title, location, applied_on, reason, {_TOKENS.format("title")} as tokens,
        concat_ws('|', company, coalesce(title, '-'), coalesce(location, '-'), applied_on::varchar, reason) as twin from sheet where applied_on is not null),
    posts as (select folder_id as posting_id, company, day, {_TOKENS.format("title")} as tokens, {_PLACE.format("title")} as place from folders where day is not null),
    scored as (select p.company as company_key, posting_id, application_id, twin, {_TITLE_POINTS.format("p.tokens", "a.tokens")} + {_PLACE_POINTS.format("a.location", "p.place")} as points
        from posts p join apps a on a.company = p.company and abs(a.applied_on - p.day) <= 4),
    ordered as (select *, row_number() over (partition by company_key order by points desc, posting_id, application_id) as i,
        list({{'a': application_id, 't': twin}}) over (partition by posting_id, points) as same from scored where points >= 0),
    steps as (
        select company_key, 0::bigint as i, []::varchar[] as done, []::varchar[] as used, []::varchar[] as torn, []::varchar[] as choices from (select distinct company_key from ordered)
        union all
        select company_key, i, case when takes then list_append(done, posting_id) else done end, case when takes then list_append(used, application_id) else used end,
            case when comes and not takes then list_append(torn, posting_id) else torn end, case when comes and not takes then list_append(choices, application_id || ',' || array_to_string(rivals, ',')) else choices end
        from (select *, comes and len(rivals) = 0 as takes from (
            select s.company_key, o.i, s.done, s.used, s.torn, s.choices, o.posting_id, o.application_id,
                list_sort(list_transform(list_filter(o.same, lambda x: x.t <> o.twin and not list_contains(s.used, x.a)), lambda x: x.a)) as rivals,
                not (list_contains(s.done, o.posting_id) or list_contains(s.torn, o.posting_id) or list_contains(s.used, o.application_id)) as comes
            from steps s join ordered o on o.company_key = s.company_key and o.i = s.i + 1))),
    ends as (select * from steps qualify row_number() over (partition by company_key order by i desc) = 1)
    select unnest(done) as posting_id, unnest(used) as application_id, null as ambiguous from ends union all select unnest(torn), null, unnest(choices) from ends"""


@query(_LINKS, "sheet", "folders")
def linked_applications(spark, sf):
    """Which application without a posting each posting belongs to."""
    apps = canonical(spark, sf, "sheet").select(F.col("row_id").alias("application_id"), "company", F.lit(None).cast("string").alias("company_slug"), "title", "location", "applied_on", F.lit("applied").alias("status"), "reason", F.lit(None).cast("string").alias("posting_id"))
    posts = canonical(spark, sf, "folders").select(F.col("folder_id").alias("posting_id"), F.col("company").alias("company_slug"), F.col("company").alias("company_name"), "title", F.col("title").alias("places"), "day")
    found = resolve.link_postings(resolve.link_candidates(posts, apps))
    return found.withColumn("ambiguous", F.array_join("ambiguous", ","))


def _table(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(values.items())) + "}"


def _either(values: dict[str, str]) -> str:
    return "|".join(sorted(values, key=lambda x: (-len(x), x)))


_NAMES, _CODES = places.country_names(build_geo())
_CITIES = places.unique_cities(build_geo())
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_COUNTRIES = f""", said as (select source_job_id, location_raw, title_raw, coalesce(location_raw, '') || ' / ' || description_raw as told, {_table(_NAMES | _CODES)} as names, {_table(_CITIES)} as cities from raw),
    found as (select *, list_transform(regexp_extract_all(coalesce(location_raw, ''), '\\b((?i:{_either(_NAMES)})|{_either(_CODES)})\\b'), lambda x: coalesce(names[x], names[lower(x)])) as named,
        list_transform(regexp_extract_all(coalesce(location_raw, ''), '(?i)\\b({_either(_CITIES)})\\b'), lambda x: cities[lower(x)]) as towns,
        list_transform(regexp_extract_all(title_raw, '\\b((?i:{_either(_NAMES)})|{_either(_CODES)})\\b'), lambda x: coalesce(names[x], names[lower(x)])) as titled,
        list_transform(regexp_extract_all(told, '\\b((?i:{_either(_NAMES)})|{_either(_CODES)})\\b'), lambda x: coalesce(names[x], names[lower(x)])) as told_names,
        list_transform(regexp_extract_all(told, '(?i)\\b({_either(_CITIES)})\\b'), lambda x: cities[lower(x)]) as told_towns from said)
    select source_job_id, array_to_string(case when len(named) > 0 then {_ORDERED.format("named")} when len(towns) > 0 then {_ORDERED.format("towns")} else {_ORDERED.format("titled")} end, ',') as of_application,
        array_to_string(case when len(told_names) > 0 then {_ORDERED.format("told_names")} else {_ORDERED.format("told_towns")} end, ',') as of_text from found"""


@query(_COUNTRIES, "raw")
def named_countries(spark, sf):
    """Countries of an application (place, else title), and those that place and description name, in order."""
    raw = canonical(spark, sf, "raw")
    told = F.concat_ws(" / ", F.coalesce("location_raw", F.lit("")), "description_raw")
    return raw.select(
        "source_job_id", F.array_join(places.application_countries(F.col("location_raw"), F.col("title_raw")), ",").alias("of_application"), F.array_join(places.countries_in(told), ",").alias("of_text")
    )


_GRAMS: dict[tuple[str, str], GramIndex] = {}


def _gram_index(spark, sf) -> GramIndex:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRAMS:
        index = GramIndex(spark, f"{shared_folder(spark)}/gram-index-{uuid4().hex}", ("line", "company"))
        apps = canonical(spark, sf, "applications")
        index.add(apps.select(F.col("application_id").alias("posting_id"), F.concat_ws(" ", "company", "title").alias("line"), "company"))
        _GRAMS[key] = index
    return _GRAMS[key]


@query("select application_id from applications where contains(lower(company || ' ' || title), '1 q')", "applications")
def applications_with_text(spark, sf):
    """Applications whose company and title hold a text anywhere, by their runs of three characters."""
    return _gram_index(spark, sf).containing("1 Q̈", ("line",)).select(F.col("posting_id").alias("application_id"))


@query("select application_id from applications where contains(lower(company), '7')", "applications")
def applications_of_company(spark, sf):
    """Applications whose company holds a character, which is shorter than a run."""
    return _gram_index(spark, sf).containing("7", ("company",)).select(F.col("posting_id").alias("application_id"))
