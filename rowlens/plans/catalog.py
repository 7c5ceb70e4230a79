"""Named queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.config import Profile, build_profile, build_taxonomy, build_tracks
from rowlens.functions import dates, money, text
from rowlens.operators import applications, dedup, facets, feed, health, normalize, periods, replay, reports, retention, review, score, search, snapshot, text_index
from rowlens.operators.feed import PostingFilter
from rowlens.plans.projection import AS_OF, _pick, canonical, store
from rowlens.plans.registry import oracle_sql, queries, query
from rowlens.session import shared_folder
from rowlens.schemas import AGGREGATORS, SOURCES
from rowlens.sources import readers

FLAGSHIP = "feed_default"

# --- feed ----------------------------------------------------------------------

BASE = ("companies", "postings", "locations", "tech", "verdicts", "flags")
FROM = "from postings p join companies c using (company_slug) left join verdicts v on v.posting_id = p.posting_id left join flags u on u.posting_id = p.posting_id"
OPEN = "p.is_canonical and p.is_active and u.application_status is null and not coalesce(u.is_hidden, false) and u.triage is null"
SHOWN = "p.visa_sponsorship in ('sponsors', 'unknown') and p.tier in ('strong', 'possible', 'stretch')"
ROW = "p.posting_id, p.company_slug, c.company_name, c.sector, p.score, p.tier"


def _row(df: DataFrame) -> DataFrame:
    return df.select("posting_id", "company_slug", "company_name", "sector", F.col("eff_score").alias("score"), F.col("eff_tier").alias("tier"))


@query(f"select {ROW} {FROM} where {OPEN} and {SHOWN} order by p.score desc, p.posting_id desc limit 50", *BASE)
def feed_default(spark, sf):
    return _row(feed.feed(store(spark, sf)))


def _filtered(name: str, flt: PostingFilter, where: str) -> None:
    """A query over all rows that one filter admits; ``where`` is the same condition in SQL."""

    def run(spark, sf):
        return _row(feed.base_feed(store(spark, sf), flt, AS_OF))

    run.__name__ = f"filter_{name}"
    query(f"select {ROW} {FROM} where {where}", *BASE)(run)


def _near(child: str, condition: str) -> str:
    return f"exists (select 1 from {child} x where x.posting_id = p.posting_id and {condition})"


_filtered("countries", PostingFilter(countries=("NATION_1", "NATION_7")), f"{OPEN} and {_near('locations', 'x.country in (' + chr(39) + 'NATION_1' + chr(39) + ', ' + chr(39) + 'NATION_7' + chr(39) + ')')}")
_filtered("cities", PostingFilter(cities=("NATION_3-x", "NATION_4-1")), f"""{OPEN} and {_near("locations", "x.city in ('NATION_3-x', 'NATION_4-1')")}""")
_filtered("place", PostingFilter(place=("NATION_4", "NATION_4-1")), f"""{OPEN} and {_near("locations", "x.country = 'NATION_4' and x.city = 'NATION_4-1'")}""")
_filtered("remote_modes", PostingFilter(remote_modes=("remote",)), f"""{OPEN} and {_near("locations", "x.remote_mode = 'remote'")}""")
_filtered(
    "columns",
    PostingFilter(companies=("s1", "s2", "s3"), sources=("lever", "ashby", "indeed"), role_families=("quant_dev", "risk", "other"), seniorities=("junior", "mid", "lead"), visa=("no", "unknown")),
    f"{OPEN} and p.company_slug in ('s1', 's2', 's3') and p.source in ('lever', 'ashby', 'indeed') and p.role_family in ('quant_dev', 'risk', 'other') and p.seniority in ('junior', 'mid', 'lead') and p.visa_sponsorship in ('no', 'unknown')",
)
_filtered("sectors", PostingFilter(sectors=("ASIA", "EUROPE", "REGION_1", "REGION_2")), f"{OPEN} and c.sector in ('ASIA', 'EUROPE', 'REGION_1', 'REGION_2')")
_filtered("tiers", PostingFilter(tiers=("strong",)), f"{OPEN} and p.tier = 'strong'")
_filtered("rejection_reasons", PostingFilter(rejection_reasons=("stale", "not_quant")), f"{OPEN} and v.rejection_reason in ('stale', 'not_quant')")
_filtered("tech_any", PostingFilter(tech_any=("kdb", "cuda")), f"""{OPEN} and {_near("tech", "x.tech in ('kdb', 'cuda')")}""")
_filtered(
    "tech_all",
    PostingFilter(tech_all=("python", "cpp")),
    f"{OPEN} and p.posting_id in (select posting_id from tech where tech in ('python', 'cpp') group by 1 having count(distinct tech) = 2)",
)
_filtered("min_score", PostingFilter(min_score=60), f"{OPEN} and p.score >= 60")
_filtered(
    "posted_within_days",
    PostingFilter(posted_within_days=200),
    f"{OPEN} and cast(case when p.posted_at < p.first_seen_at then p.posted_at else p.first_seen_at end as date) >= date '2001-06-01' - interval '200' day",
)
_filtered("statuses", PostingFilter(statuses=("applied", "interview")), "p.is_canonical and u.application_status in ('applied', 'interview') and not coalesce(u.is_hidden, false) and u.triage is null")
_filtered("favorites", PostingFilter(favorites_only=True, include_hidden=True), "p.is_canonical and u.is_favorite and u.triage is null")
_filtered("triage", PostingFilter(triage="maybe"), "p.is_canonical and not coalesce(u.is_hidden, false) and u.triage = 'maybe'")


@query(
    """select p.posting_id, p.company_slug, c.company_name, c.sector, t.score, t.tier
    from postings p join companies c using (company_slug) join track_verdicts t on t.posting_id = p.posting_id and t.track = 'tech' left join flags u on u.posting_id = p.posting_id
    where p.is_canonical and p.is_active and u.application_status is null and not coalesce(u.is_hidden, false) and u.triage is null and t.score >= 25""",
    *BASE, "track_verdicts",
)
def filter_track(spark, sf):
    return _row(feed.base_feed(store(spark, sf), PostingFilter(track="tech", min_score=25)))


@query(f"select {ROW} {FROM} where {OPEN} and p.title ilike '%quant%' and p.posting_id in (select posting_id from texts where description ilike '%relocation support%')", *BASE, "texts")
def filter_text(spark, sf):
    match = search.Match(phrases=("relocation support",), prefixes=("quant",), none=("astrology",))
    return _row(feed.base_feed(store(spark, sf), PostingFilter(query=match)))


def _index(spark: SparkSession, sf: str) -> text_index.TextIndex:
    """The index of a folder's texts, written once a session in two batches, the second of which replaces some texts of the first."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        texts = canonical(spark, sf, "texts")
        again = F.col("posting_id").cast("long") % 3 == 0
        index = text_index.TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid4().hex}")
        index.add(texts.withColumn("description", F.when(again, F.lit("relocation support and more relocation support")).otherwise(F.col("description"))))
        index.add(texts.filter(again))
        _INDEXES[key] = index
    return _INDEXES[key]


_INDEXES: dict[tuple[str, str], text_index.TextIndex] = {}


@query(oracle_sql()["filter_text"])
def filter_text_indexed(spark, sf):
    """The condition of ``filter_text`` answered by the written index; no text is read."""
    match = search.Match(phrases=("relocation support",), prefixes=("quant",), none=("astrology",))
    return _row(feed.base_feed(store(spark, sf), PostingFilter()).join(_index(spark, sf).matching(match), "posting_id", "left_semi"))


_SAID = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({0}), '[^a-zà-ÿ0-9]+'), lambda w: w <> ''), ' ') || ' '"


@query(f"select posting_id from texts where contains({_SAID.format('description')}, ' years of experience ') and (contains({_SAID.format('description')}, ' rust ') or contains({_SAID.format('description')}, ' right to work '))", "texts")
def search_phrases(spark, sf):
    """Words in a row and one of several words, in descriptions."""
    return _index(spark, sf).matching(search.Match(phrases=("years of experience",), any=("Rust", "right to work"), columns=("description",)))


@query(f"select posting_id from texts where contains({_SAID.format('title')}, ' software eng') and not contains({_SAID.format('title')}, ' graduate ') and not contains({_SAID.format('description')}, ' graduate ')", "texts")
def search_prefixes(spark, sf):
    """The beginning of a phrase, without a word."""
    return _index(spark, sf).matching(search.Match(prefixes=("Software eng",), none=("graduate",), columns=("title", "description")))


_SORT_SQL = {"posted": "p.posted_at desc nulls last, p.posting_id desc", "seen": "p.first_seen_at desc nulls last, p.posting_id desc", "company": "p.company_slug asc nulls last, p.posting_id asc", "closes": "p.closes_at asc nulls last, p.posting_id asc"}


def _sorted(sort: str) -> None:
    def run(spark, sf):
        return _row(feed.feed(store(spark, sf), sort=sort, limit=100))

    run.__name__ = f"feed_by_{sort}"
    query(f"select {ROW} {FROM} where {OPEN} and {SHOWN} order by {_SORT_SQL[sort]} limit 100", *BASE)(run)


for _s in _SORT_SQL:
    _sorted(_s)


@query(f"select {ROW} {FROM} where {OPEN} and {SHOWN} and (p.score < 60 or (p.score = 60 and p.posting_id < '0000000500') or p.score is null) order by p.score desc, p.posting_id desc limit 50", *BASE)
def feed_second_page(spark, sf):
    return _row(feed.feed(store(spark, sf), cursor=feed.encode_cursor(60, "0000000500")))


@query("select company_slug, company_name, hq_country from companies where not discovered and sector = (select min(sector) from companies)", "companies")
def company_registry(spark, sf):
    companies = canonical(spark, sf, "companies")
    first = companies.agg(F.min("sector").alias("sector"))
    return feed.company_list(companies).join(first, "sector", "left_semi").select("company_slug", "company_name", "hq_country")


# --- facets and map ----------------------------------------------------------------


def _facet_sql(dimension: str, value: str, join: str, where: str) -> str:
    return f"select '{dimension}' as dimension, {value} as value, count(distinct p.posting_id) as n {FROM} {join} where {where} and {value} is not null group by 2"


_L, _T = "left join locations l on l.posting_id = p.posting_id", "left join tech t on t.posting_id = p.posting_id"
_FACET_FILTER = PostingFilter(tiers=("strong", "possible"), sources=("lever", "ashby", "indeed", "workday"), tech_any=("python", "kdb"), countries=("NATION_1", "NATION_2", "NATION_3"))
_PARTS = {
    "base": f"{OPEN} and p.tier in ('strong', 'possible')",
    "sources": "p.source in ('lever', 'ashby', 'indeed', 'workday')",
    "tech": _near("tech", "x.tech in ('python', 'kdb')"),
    "countries": _near("locations", "x.country in ('NATION_1', 'NATION_2', 'NATION_3')"),
}


def _without(*left_out: str) -> str:
    return " and ".join(v for k, v in _PARTS.items() if k not in left_out)


@query(
    " union all ".join([
        _facet_sql("countries", "l.country", _L, _without("countries")), _facet_sql("cities", "l.city", _L, _without()), _facet_sql("companies", "p.company_slug", "", _without()),
        _facet_sql("sectors", "c.sector", "", _without()), _facet_sql("sources", "p.source", "", _without("sources")), _facet_sql("seniorities", "p.seniority", "", _without()),
        _facet_sql("tech", "t.tech", _T, _without("tech")), _facet_sql("rejection_reasons", "v.rejection_reason", "", _without()),
    ]),
    *BASE,
)
def facet_counts(spark, sf):
    return facets.facet_counts(store(spark, sf), _FACET_FILTER)


_PLACED = "l.city is not null and l.remote_mode in ('remote', 'hybrid')"
_MODES = _near("locations", "x.remote_mode in ('remote', 'hybrid')")


@query(f"select l.country, l.city, count(distinct p.posting_id) as n, min(p.posting_id) as sample {FROM} join locations l on l.posting_id = p.posting_id where {OPEN} and {_MODES} and {_PLACED} group by 1, 2", *BASE)
def map_locations(spark, sf):
    return facets.location_counts(store(spark, sf), PostingFilter(remote_modes=("remote", "hybrid")))


@query(
    f"""select total, placed, total - placed as unplaced from (select count(*) as total, count(*) filter ({_near("locations", "x.city is not null and x.remote_mode in ('remote', 'hybrid')")}) as placed {FROM} where {OPEN} and {_MODES})""",
    *BASE,
)
def map_totals(spark, sf):
    return facets.map_totals(store(spark, sf), PostingFilter(remote_modes=("remote", "hybrid")))


@query(
    f"select coalesce(f.value, s.value) as value, coalesce(f.n, 0) as n from (select p.seniority as value, count(*) as n {FROM} where {OPEN} and p.score >= 80 group by 1) f full join (select 'intern' as value union all select 'never') s on f.value = s.value",
    *BASE,
)
def facet_options(spark, sf):
    counts = facets.facet(store(spark, sf), "seniorities", PostingFilter(min_score=80))
    return facets.options(counts, spark.createDataFrame([("intern",), ("never",)], "value string"))


# --- reports -------------------------------------------------------------------------

LIVE = "p.is_active and p.is_canonical"


@query(
    f"""select 'companies' as kind, 'all' as key, count(distinct company_slug) as n from postings p where {LIVE}
    union all select 'sector', c.sector, count(*) from postings p join companies c using (company_slug) where {LIVE} group by 2
    union all select 'country', l.country, count(distinct p.posting_id) from postings p join locations l using (posting_id) where {LIVE} group by 2""",
    "postings", "companies", "locations",
)
def coverage(spark, sf):
    s = store(spark, sf)
    total = reports.coverage_totals(s).select(F.lit("companies").alias("kind"), F.lit("all").alias("key"), F.col("companies").alias("n"))
    sector = reports.coverage_by_sector(s).select(F.lit("sector").alias("kind"), F.col("sector").alias("key"), "n")
    country = reports.coverage_by_country(s).select(F.lit("country").alias("kind"), F.col("country").alias("key"), "n")
    return total.unionByName(sector).unionByName(country)


#: Some months after the last posting, when part of the companies have gone silent.
QUIET = "2001-12-01 00:00:00"


@query(
    f"select company_slug from companies c where enabled and not discovered and not exists (select 1 from postings p where p.company_slug = c.company_slug and p.is_active and p.last_seen_at >= timestamp '{QUIET}' - interval '20' day)",
    "companies", "postings",
)
def silent_companies(spark, sf):
    return reports.silent_companies(store(spark, sf), QUIET, days=20)


_COHORT = f"""cohort as (select *, cast(ceil((epoch(timestamp '{AS_OF}') - epoch(first_seen_at)) / 604800.0) - 1 as int) as week from postings
    where is_canonical and first_seen_at >= timestamp '{AS_OF}' - interval '28' day and first_seen_at < timestamp '{AS_OF}')"""


def _rate(name: str, test: str) -> str:
    return f"coalesce(round(avg(case when {test} then 1.0 else 0.0 end), 6), 0.0) as {name}"


@query(
    f"""select w.week, count(p.posting_id) as postings, {_rate("seniority", "p.seniority <> 'unknown'")}, {_rate("visa", "p.visa_sponsorship <> 'unknown'")}, {_rate("role", "p.role_family <> 'other'")},
    {_rate("location", "exists (select 1 from locations l where l.posting_id = p.posting_id and l.country is not null)")}, {_rate("tech", "exists (select 1 from tech t where t.posting_id = p.posting_id)")},
    {_rate("compensation", "p.salary_min is not null")}
    from (select cast(unnest(range(4)) as int) as week) w left join (with {_COHORT} select * from cohort) p on p.week = w.week group by w.week""",
    "postings", "locations", "tech",
)
def weekly_resolution(spark, sf):
    found = reports.weekly_resolution(store(spark, sf), AS_OF)
    # a week without postings has no rate of its own
    return found.select("week", "postings", *[F.round(s, 6).alias(s) for s in reports.STAGES])


@query(
    f"""select w.week, count(*) filter (p.tier = 'strong') as strong, count(*) filter (p.tier = 'possible') as possible, count(*) filter (p.tier = 'stretch') as stretch, count(*) filter (p.tier = 'rejected') as rejected
    from (select cast(unnest(range(4)) as int) as week) w left join (with {_COHORT} select * from cohort) p on p.week = w.week group by w.week""",
    "postings",
)
def tiers_by_week(spark, sf):
    return reports.tiers_by_week(store(spark, sf), AS_OF)


@query("select v.rejection_reason as reason, count(*) as n from verdicts v join postings p using (posting_id) where p.is_canonical and v.rejection_reason is not null group by 1 order by n desc, reason limit 10", "postings", "verdicts")
def rejection_reasons(spark, sf):
    return reports.rejection_reasons(store(spark, sf))


@query(
    "select r.resolved, q.queued, q.skipped, r.resolved * 1600 / 40 as gpu_seconds from (select count(*) filter (resolver_stage = 'llm') as resolved from postings) r, (select count(*) as queued, coalesce(sum(attempts), 0)::bigint as skipped from (select o_orderkey % 4 as attempts from orders where o_orderkey % 50 = 0)) q",
    "postings",
)
def llm_load(spark, sf):
    queue = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") % 4).alias("attempts"))
    return reports.llm_load(canonical(spark, sf, "postings"), queue)


@query("select p.posting_id, p.title, p.company_slug, v.score, v.tier, v.rejection_reason from flags f join postings p using (posting_id) join verdicts v using (posting_id) where f.is_favorite", "postings", "verdicts", "flags")
def favorites(spark, sf):
    return reports.favorites(store(spark, sf))


def _lift_sql(fav: str, base: str) -> str:
    return f"""select f.key, f.n as favorites, round(f.n / (select sum(n) from ({fav})), 9) as favorite_share, round(b.n / (select sum(n) from ({base})), 9) as base_share,
        round((f.n / (select sum(n) from ({fav}))) / (b.n / (select sum(n) from ({base}))), 6) as lift from ({fav}) f join ({base}) b using (key)"""


def _rounded_lift(df: DataFrame) -> DataFrame:
    return df.select("key", "favorites", F.round("favorite_share", 9).alias("favorite_share"), F.round("base_share", 9).alias("base_share"), F.round("lift", 6).alias("lift"))


@query(_lift_sql("select company_slug as key, count(*) as n from flags join postings using (posting_id) where is_favorite group by 1", "select company_slug as key, count(*) as n from postings where is_active and is_canonical group by 1"), "postings", "flags")
def company_lifts(spark, sf):
    return _rounded_lift(reports.company_lifts(store(spark, sf)))


@query(_lift_sql("select tech as key, count(*) as n from flags join tech using (posting_id) where is_favorite group by 1", "select tech as key, count(*) as n from tech join postings using (posting_id) where is_active and is_canonical group by 1"), "postings", "flags", "tech")
def tech_lifts(spark, sf):
    return _rounded_lift(reports.tech_lifts(store(spark, sf)))


@query("select company_slug, company_name, count(p.posting_id) as n from companies left join (select * from postings where is_active) p using (company_slug) where discovered group by 1, 2", "companies", "postings")
def discovered_employers(spark, sf):
    return reports.discovered_employers(store(spark, sf))


@query("select company_slug, company_name, count(p.posting_id) as n from companies left join (select * from postings where is_active and is_canonical) p using (company_slug) where not discovered group by 1, 2", "companies", "postings")
def company_counts(spark, sf):
    return reports.company_counts(store(spark, sf))


# --- duplicates ------------------------------------------------------------------------

_DUP = """dup as (select p.*, u.posting_id is not null as flagged, count(*) filter (not regexp_matches(coalesce(location_raw, ''), '^[0-9].* Location')) over g as named, row_number() over (partition by fingerprint, source, company_slug, content_hash
    order by u.posting_id is not null desc, p.score desc, p.last_seen_at desc, p.posting_id desc) as place, count(u.posting_id) over g <= 1 as merges
    from postings p left join flags u using (posting_id) where is_canonical and is_active window g as (partition by fingerprint, source, company_slug, content_hash))"""


@query(f"select fingerprint, source, company_slug, content_hash, posting_id, place::int as place, merges from (with {_DUP} select * from dup) where named > 1", "postings", "flags")
def duplicate_groups(spark, sf):
    return dedup.duplicate_members(store(spark, sf))


@query("select fingerprint, posting_id from (select fingerprint, posting_id, row_number() over (partition by fingerprint order by is_active desc, last_seen_at desc, posting_id) as n from postings where is_canonical) where n = 1", "postings")
def canonical_rows(spark, sf):
    return dedup.canonical_by_fingerprint(canonical(spark, sf, "postings")).select("fingerprint", "posting_id")


# --- health -------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"
_TRIES = """recent as (select *, row_number() over (partition by source order by started_at desc, run_id desc) as nth from runs),
    tries as (select *, row_number() over (partition by source order by started_at desc, run_id desc) as place from recent where nth <= 50 and company_slug is null and status <> 'skipped')"""


@query(
    f"""with {_TRIES}, stats as (select source, max(started_at) filter (place = 1) as last_at, max(fetched) filter (place = 1) as last_count, count(*) filter (place <= 3 and status = 'empty') as empties,
    quantile_cont(fetched, 0.5) filter (place between 2 and 7) as med from tries group by 1)
    select source, last_count, case when empties = 3 then 'source_mute' when med > 0 and last_count < med * 0.2 then 'volume_drop' end as alert from stats""".replace("with recent", ", recent", 1),
    "runs",
)
def run_alerts(spark, sf):
    return health.run_alerts(canonical(spark, sf, "runs")).select("source", "last_count", "alert")


@query(
    """, recent as (select *, row_number() over (partition by source order by started_at desc, run_id desc) as nth from runs),
    latest as (select source, company_slug, arg_max(status, (started_at, run_id)) as status from recent where nth <= 50 and company_slug is not null group by 1, 2)
    select source, count(*) filter (status in ('ok', 'empty')) as boards_ok, count(*) filter (status in ('error', 'blocked')) as boards_error from latest group by 1""",
    "runs",
)
def board_counts(spark, sf):
    return health.board_counts(canonical(spark, sf, "runs"))


@query(
    f""", {_TRIES}, streak as (select source, coalesce(min(place) filter (status not in ('error', 'blocked')), max(place) + 1) - 1 as failures, max(status) filter (place = 1) as status, max(ended_at) filter (place = 1) as ended from tries group by 1),
    judged as (select source, failures::int as failures, status in ('error', 'blocked') and (status = 'blocked' or failures >= 3) as tripped, epoch(ended) + least(30.0 * pow(2.0, failures - 1), 3600.0)::bigint as retry from streak)
    select source, failures, case when not tripped then 'closed' when epoch(timestamp '{NOW}') >= floor(retry) then 'half_open' else 'open' end as state from judged""",
    "runs",
)
def breaker_state(spark, sf):
    return health.breaker(canonical(spark, sf, "runs"), NOW).select("source", "failures", "state")


@query(
    f"""select c.company_slug, c.priority from companies c left join (select source, company_slug, max(started_at) as last from runs where company_slug is not null group by 1, 2) r on r.source = c.source and r.company_slug = c.company_slug
    where enabled and (priority <= 1 or last is null or epoch(timestamp '{NOW}') - floor(epoch(last)) >= case priority when 2 then 86400 when 3 then 604800 end)""",
    "companies", "runs",
)
def due_boards(spark, sf):
    return health.due_boards(canonical(spark, sf, "companies"), canonical(spark, sf, "runs"), NOW).select("company_slug", "priority")


@query(
    """select source, sum(fetched)::bigint as fetched, sum(new)::bigint as new, sum(updated)::bigint as updated,
    case when count(*) filter (status = 'blocked') > 0 then 'blocked' when count(*) filter (status <> 'skipped') = 0 then 'skipped' when count(*) filter (status in ('ok', 'empty')) = 0 then 'error' when sum(fetched) > 0 then 'ok' else 'empty' end as status
    from runs where company_slug is not null group by 1""",
    "runs",
)
def cycle_rows(spark, sf):
    rows = health.cycle_row(canonical(spark, sf, "runs").filter("company_slug is not null"))
    return rows.select("source", "fetched", "new", "updated", "status")


#: The cycle's breaker here trips at one failure and waits an hour or more, so that all three states occur.
_CYCLE = {"threshold": 1, "base": 3600.0, "most": 36000.0}
_SEED = "cycle"


@query(
    f""", {_TRIES}, streak as (select source, coalesce(min(place) filter (status not in ('error', 'blocked')), max(place) + 1) - 1 as failures, max(status) filter (place = 1) as status, max(ended_at) filter (place = 1) as ended from tries group by 1),
    judged as (select source, status in ('error', 'blocked') as tripped, epoch(ended) + least(3600.0 * pow(2.0, failures - 1), 36000.0)::bigint as retry from streak),
    gate as (select source, case when not tripped then 'closed' when epoch(timestamp '{NOW}') >= floor(retry) then 'half_open' else 'open' end as state from judged),
    answers as (select company_slug, arg_max(case when status = 'error' and new = 0 then 'blocked' else status end, (started_at, run_id)) as status, arg_max(fetched, (started_at, run_id)) as fetched, arg_max(new, (started_at, run_id)) as new, arg_max(updated, (started_at, run_id)) as updated from runs where company_slug is not null and status <> 'skipped' group by 1),
    tried as (select source, company_slug, max(started_at) as last from runs where company_slug is not null group by 1, 2),
    board as (select c.source, c.company_slug, coalesce(g.state, 'closed') as state, md5('{_SEED}:' || c.source || ':' || c.company_slug) as lot, coalesce(a.status, 'empty') as status, coalesce(fetched, 0) as fetched, coalesce(new, 0) as new, coalesce(updated, 0) as updated
        from companies c left join gate g on g.source = c.source left join answers a on a.company_slug = c.company_slug left join tried t on t.source = c.source and t.company_slug = c.company_slug
        where enabled and (priority <= 1 or last is null or epoch(timestamp '{NOW}') - floor(epoch(last)) >= case priority when 2 then 86400 when 3 then 604800 end)),
    planned as (select *, row_number() over (partition by source order by lot) as turn from board where state <> 'open' qualify state = 'closed' or turn = 1),
    walls as (select source, min(lot) as wall from planned where status = 'blocked' and source not in ('workday', 'custom') group by 1),
    asked as (select p.* from planned p left join walls w on w.source = p.source where wall is null or lot <= wall),
    whole as (select c.source, any_value(g.state) as state, count(a.lot) as n, count(*) filter (a.status = 'blocked' and c.source not in ('workday', 'custom')) as walls, count(*) filter (a.status in ('ok', 'empty')) as good,
        coalesce(sum(a.fetched), 0) as fetched, coalesce(sum(a.new), 0) as new, coalesce(sum(a.updated), 0) as updated from (select distinct source from companies) c left join gate g on g.source = c.source left join asked a on a.source = c.source group by 1)
    select source, company_slug, status, null::varchar as error_kind, fetched::bigint as fetched, new::bigint as new, updated::bigint as updated from asked
    union all select source, null, case when walls > 0 then 'blocked' when n = 0 then 'skipped' when good = 0 then 'error' when fetched > 0 then 'ok' else 'empty' end, case when state = 'open' then 'breaker_open' end, fetched::bigint, new::bigint, updated::bigint from whole""",
    "companies", "runs",
)
def source_cycle(spark, sf):
    """One cycle over all sources; a board answers as its company's newest run did (errors without a new record as blocks), one without a run with nothing."""
    companies, runs = canonical(spark, sf, "companies"), canonical(spark, sf, "runs")
    told = runs.filter("company_slug is not null and status <> 'skipped'").withColumn("status", F.expr("case when status = 'error' and new = 0 then 'blocked' else status end"))
    newest = told.groupBy("company_slug").agg(F.max_by(F.struct("status", *health.COUNTS), F.struct("started_at", "run_id")).alias("r")).select("company_slug", "r.*")
    answers = companies.select("source", "company_slug").join(newest, "company_slug", "left").fillna({"status": "empty"} | dict.fromkeys(health.COUNTS, 0))
    plan = health.plan_cycle(companies, runs, NOW, _SEED, **_CYCLE)
    return health.cycle_log(companies, runs, plan, answers, NOW, **_CYCLE).drop("aliased", "rejected")


# --- retention -------------------------------------------------------------------------------


@query(
    f"""select posting_id from postings p where not (not is_active and last_seen_at < timestamp '{AS_OF}' - interval '180' day and posting_id not in (select posting_id from flags)
    and posting_id not in (select posting_id from applications where posting_id is not null))""",
    "postings", "flags", "applications",
)
def kept_postings(spark, sf):
    s = store(spark, sf)
    return retention.kept_postings(s.postings, s.flags, canonical(spark, sf, "applications"), AS_OF).select("posting_id")


@query(
    f"""select source_job_id, posting_id from (select lpad(substr(source_job_id, 2), 10, '0') as posting_id, source_job_id, fetched_at from raw) r left join verdicts v using (posting_id)
    where ((v.rejection_reason = 'not_quant' and fetched_at < timestamp '{AS_OF}' - interval '90' day) or (coalesce(v.rejection_reason, '') <> 'not_quant' and fetched_at < timestamp '{AS_OF}' - interval '365' day)) is not true""",
    "raw", "verdicts",
)
def kept_payloads(spark, sf):
    payloads = canonical(spark, sf, "raw").select("source_job_id", "fetched_at", F.lpad(F.substring("source_job_id", 2, 20), 10, "0").alias("posting_id"))
    return retention.kept_payloads(payloads, canonical(spark, sf, "verdicts"), AS_OF).select("source_job_id", "posting_id")


# --- scalars ----------------------------------------------------------------------------------


@query(
    """select source_job_id, sha256(title_raw || chr(31) || description_raw || chr(31) || coalesce(location_raw, '')) as content_hash,
    array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(title_raw), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[a-z0-9]+'),
        lambda w: w not in ('start', 'starting', 'intake', 'cohort', 'req', 'ref', 'job', 'f', 'h', 'm', 'w', 'd', 'x') and not regexp_full_match(w, '\\d{3,}')), ' ') as title_key,
    substr(sha256(source || chr(31) || company_slug || chr(31) || source_job_id), 1, 26) as posting_id from raw""",
    "raw",
)
def hashes(spark, sf):
    raw = canonical(spark, sf, "raw")
    return raw.select(
        "source_job_id", text.content_hash(F.col("title_raw"), F.col("description_raw"), F.col("location_raw")).alias("content_hash"), text.fingerprint_title(F.col("title_raw")).alias("title_key"),
        text.posting_id(F.col("source"), F.col("company_slug"), F.col("source_job_id")).alias("posting_id"),
    )


@query(
    f"""select posting_id, cast(floor((epoch(timestamp '{AS_OF}') - floor(epoch(coalesce(posted_at, first_seen_at)))) / 86400) as int) as age,
    case when posted_at < first_seen_at then cast(posted_at as date) else cast(first_seen_at as date) end as feed_day, cast(cast(first_seen_at as date) + interval '5' month as date) as later from postings""",
    "postings",
)
def posting_dates(spark, sf):
    p = canonical(spark, sf, "postings")
    feed_day = dates.feed_date(F.col("posted_at"), F.col("first_seen_at")).cast("date")
    return p.select("posting_id", score.age(AS_OF).alias("age"), feed_day.alias("feed_day"), dates.months_after(F.col("first_seen_at").cast("date"), 5).alias("later"))


@query(
    """select source_job_id, n, m, case when lower(m) = 'k' then v * 1000 when lower(m) = 'm' then v * 1000000 else v end as amount from (select source_job_id, n, m, try_cast(case when n like '%,%' and n like '%.%' then replace(n, ',', '')
    when regexp_full_match(n, '\\d{1,3}(,\\d{3})+') then replace(n, ',', '') when regexp_full_match(n, '\\d{1,3}(\\.\\d{3})+') then replace(n, '.', '') else n end as double) as v
    from (select source_job_id, regexp_extract(description_raw, '(\\d[\\d.,]*\\d|\\d)([kKmM]?)', 1) as n, regexp_extract(description_raw, '(\\d[\\d.,]*\\d|\\d)([kKmM]?)', 2) as m from
        (select source_job_id, regexp_extract(description_raw, '[$€£].*|Pay.*|budget.*', 0) as description_raw from raw)))""",
    "raw",
)
def amounts(spark, sf):
    """The first number behind a sign of pay in every raw description, as an amount."""
    said = F.regexp_extract("description_raw", "[$€£].*|Pay.*|budget.*", 0)
    rows = canonical(spark, sf, "raw").select("source_job_id", *[F.regexp_extract(said, r"(\d[\d.,]*\d|\d)([kKmM]?)", k).alias(c) for k, c in ((1, "n"), (2, "m"))])
    return rows.select("source_job_id", "n", "m", money.parse_amount(F.col("n"), F.col("m")).cast("double").alias("amount"))


# --- normalize and score -----------------------------------------------------------------------


_RULES = build_taxonomy()


def _has(text_sql: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text_sql}, '{w}')" for w in words) + ")"


_ROLE = f"""case when {_has("t", _RULES.trading)} then 'quant_trading' when {_has("t", _RULES.other)} then 'other' when {_has("t", _RULES.data_eng)} then 'data_eng' when {_has("t", _RULES.risk)} then 'risk'
    when {_has("t", _RULES.dev_strong)} then 'quant_dev'
    when {_has("t", _RULES.engineering)} or (({_has("t", _RULES.dev_context)} or {_has("t", _RULES.infra_context)}) and not {_has("t", _RULES.research)})
        then case when {_has("t", _RULES.dev_context)} then 'quant_dev' when {_has("t", _RULES.infra_context)} then 'swe_platform' when {_has("d", _RULES.dev_context)} then 'quant_dev' else 'swe_platform' end
    when {_has("t", _RULES.research)} or {_has("t", _RULES.quant_research)} or contains(t, ' quant ') then 'quant_research' else 'other' end"""
_LEVEL = f"""case when min_years is not null then case when {_has("t", _RULES.programme)} and min_years <= 2 then 'graduate' when min_years <= 2 then 'junior' when min_years <= 4 then 'mid' else 'senior' end
    when {_has("t", _RULES.programme)} then 'graduate' when {_has("t", _RULES.level_words["lead"])} then 'lead' when {_has("t", _RULES.level_words["senior"])} then 'senior' when {_has("t", _RULES.level_words["junior"])} then 'junior' else 'unknown' end"""
_YEARS = "(\\d{1,2})\\s*(\\+|(-|to)\\s*\\d{1,2}\\s*\\+?)?\\s*years?\\b"
_MARKS = ", ".join(f"{{'n': " + " + ".join(f"contains(d, '{m}')::int" for m in own) + f", 'o': {-k}, 'lang': '{lang}'}}" for k, (lang, own) in enumerate(_RULES.language_markers.items()))
_TAGS = {
    "cpp": "contains(d, 'c++')", "fpga": "regexp_matches(d, '\\b(fpga|verilog)\\b')", "kdb": "contains(d, 'kdb')", "go": "list_contains(items, 'go')",
    **{tag: f"regexp_matches(d, '\\b{tag}\\b')" for tag in ("java", "linux", "python", "rust", "sql")},
}
_TEXT_SQL = f""", lines as (select source_job_id, ' ' || lower(title_raw) || ' ' as t, ' ' || lower(description_raw) || ' ' as d, description_raw as w,
        string_split_regex(lower(description_raw), '[!?;]+|\\.\\s|\\.$') as said, list_transform(string_split_regex(lower(description_raw), '[,/;:()]|\\band\\b|\\bor\\b|\\.\\s|\\.$'), lambda x: trim(x)) as items from raw),
    asked as (select *, try_cast(regexp_extract(list_filter(said, lambda x: regexp_matches(x, '{_YEARS}') and not regexp_matches(x, '\\b(history|founded|since|we have)\\b')
        and (regexp_matches(x, '\\b(minimum|least|experience|required?|needs?|must)\\b') or regexp_matches(x, '\\d\\s*(\\+|-\\s*\\d)')))[1], '{_YEARS}', 1) as int) as min_years,
        array_to_string(list_filter(said, lambda x: regexp_matches(x, '\\b(fluent|bilingual)\\b')), ' | ') as fluent,
        coalesce(nullif(regexp_extract(w, '(?i)([a-z]+ )?not sponsor|have the right to work', 0), ''), nullif(regexp_extract(w, '(?i)\\([a-z ]+ only\\)', 0), '')) as no,
        nullif(regexp_extract(w, '(?i)visa sponsorship is available|relocation support', 0), '') as yes,
        list_sort([{_MARKS}], 'desc')[1] as mark from lines)
    select source_job_id, {_ROLE} as role_family, {_LEVEL} as seniority, coalesce(min_years, -1) as min_years,
        len(list_filter(said, lambda x: regexp_matches(x, '\\bphd\\b') and regexp_matches(x, '\\b(required|must)\\b') and not regexp_matches(x, '\\b(preferred|plus|or|not|no)\\b'))) > 0 as phd_required,
        case when no is not null then 'no' when yes is not null then 'sponsors' else 'unknown' end as visa_sponsorship, coalesce(no, yes) as visa_evidence,
        array_to_string(list_sort(list_filter([{", ".join(f"case when {test} then '{tag}' end" for tag, test in _TAGS.items())}], lambda x: x is not null)), ',') as tech,
        concat_ws(',', case when regexp_matches(fluent, '\\bgerman\\b') then 'de' end, case when regexp_matches(fluent, '\\benglish\\b') then 'en' end, case when regexp_matches(fluent, '\\bfrench\\b') then 'fr' end) as languages_required,
        case when mark.n > 0 then mark.lang else 'en' end as language from asked"""


@query(_TEXT_SQL, "raw")
def text_fields(spark, sf):
    found = normalize.text_fields(canonical(spark, sf, "raw"))
    names = ("source_job_id", "role_family", "seniority", "min_years", "phd_required", "visa_sponsorship", "visa_evidence", "language")
    found = found.withColumn("min_years", F.coalesce("min_years", F.lit(-1)))
    return found.select(*names, F.array_join("tech", ",").alias("tech"), F.array_join("languages_required", ",").alias("languages_required"))


@query(
    f"select t as title, {_ROLE} as role, count(*) as n from (select title_raw as title, ' ' || lower(title_raw) || ' ' as t, ' ' || lower(description_raw) || ' ' as d from raw) group by title, t, role".replace("select t as title", "select title"),
    "raw",
)
def roles(spark, sf):
    raw = canonical(spark, sf, "raw").select(F.col("title_raw").alias("title"), normalize.role_family(F.col("title_raw"), F.col("description_raw")).alias("role"))
    return raw.groupBy("title", "role").agg(F.count(F.lit(1)).alias("n"))


#: What each location text names: city, country, region and mode of its places in order of city and country.
_PLACES = (
    ("London, UK", "London|GB|emea|unknown"), ("Paris", "Paris|FR|emea|unknown"), ("3 Locations", "|||unknown"), ("Hybrid - New York, NY", "New York|US|amer|hybrid"), ("Remote - EMEA", "||emea|remote"),
    ("Zurich / Paris", "Paris|FR|emea|unknown;Zurich|CH|emea|unknown"), ("Pune, India", "Pune|IN|apac|unknown"), ("Cambridge", "|||unknown"), ("Plano, TX", "Plano|US|amer|unknown"),
    ("Dublin Ireland", "Dublin|IE|emea|unknown"), ("Chicago Office and Paris", "Chicago|US|amer|unknown;Paris|FR|emea|unknown"), ("Switzerland - Zürich", "Zurich|CH|emea|unknown"),
    ("Multiple locations", "|||unknown"), ("Remote (US only)", "|US|amer|remote"), ("NYC; Singapore", "New York|US|amer|unknown;Singapore|SG|apac|unknown"), ("Cambridge MA", "Cambridge|US|amer|unknown"),
    ("Hybrid: Berlin, Germany", "Berlin|DE|emea|hybrid"),
)
_PLACE_ROWS = ", ".join(f"('{said}', '{want}')" for said, want in _PLACES)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(canonical(spark, sf, "raw"))


@query(
    f"select source_job_id, coalesce(want, '|||unknown') as places from raw left join (values {_PLACE_ROWS}) v(said, want) on location_raw = said",
    "raw",
)
def raw_places(spark, sf):
    named = F.transform("locations", lambda x: F.concat_ws("|", F.coalesce(x["city"], F.lit("")), F.coalesce(x["country"], F.lit("")), F.coalesce(x["region"], F.lit("")), x["remote_mode"]))
    return normalized(spark, sf).select("source_job_id", F.array_join(F.array_sort(named), ";").alias("places"))


@query(
    """, lines as (select source_job_id, description_raw as d, regexp_extract(description_raw, 'Salary: \\$(\\d+),000 - \\$(\\d+),000', ['a', 'b']) as s, regexp_extract(description_raw, 'pay is (\\d+) EUR', 1) as e,
        regexp_extract(description_raw, '£(\\d+)k - £(\\d+)k', ['a', 'b']) as g, regexp_extract(description_raw, 'Pay of (\\d+),500 CHF', 1) as c from raw)
    select source_job_id, case when s.a <> '' then try_cast(s.a as double) * 1000 when e <> '' then try_cast(e as double) when g.a <> '' then try_cast(g.a as double) * 1000 when c <> '' then try_cast(c as double) * 1000 + 500 end as amount_min,
        case when s.a <> '' then try_cast(s.b as double) * 1000 when e <> '' then try_cast(e as double) when g.a <> '' then try_cast(g.b as double) * 1000 when c <> '' then try_cast(c as double) * 1000 + 500 end as amount_max,
        case when s.a <> '' then 'USD' when e <> '' then 'EUR' when g.a <> '' then 'GBP' when c <> '' then 'CHF' end as currency, case when e <> '' then 'day' when c <> '' then 'month' when s.a <> '' or g.a <> '' then 'year' end as period,
        contains(d, 'Bonus') as bonus_mentioned, contains(d, 'equity') as equity_mentioned from lines""",
    "raw",
)
def raw_pay(spark, sf):
    pay = normalized(spark, sf).select("source_job_id", "compensation.*")
    return pay.select("source_job_id", F.col("amount_min").cast("double").alias("amount_min"), F.col("amount_max").cast("double").alias("amount_max"), "currency", "period", "bonus_mentioned", "equity_mentioned")


_FIELDS_HEAD, _FIELDS_TAIL = _TEXT_SQL.rsplit("\n    select source_job_id", 1)
_KEY = """array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(title), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[a-z0-9]+'),
        lambda w: w not in ('start', 'starting', 'intake', 'cohort', 'req', 'ref', 'job', 'f', 'h', 'm', 'w', 'd', 'x') and not regexp_full_match(w, '\\d{3,}')), ' ')"""


@query(
    f"""{_FIELDS_HEAD}, fields as (select source_job_id{_FIELDS_TAIL}), dated as (select source_job_id, substr(sha256(source || chr(31) || company_slug || chr(31) || source_job_id), 1, 26) as posting_id, source, company_slug, title_raw,
    case when posted_at_raw = '2001-02-03' and timestamp '2001-02-03 00:00:00' <= fetched_at then timestamp '2001-02-03 00:00:00' when posted_at_raw = '2001-02-03T10:00:00Z' and timestamp '2001-02-03 10:00:00' <= fetched_at then timestamp '2001-02-03 10:00:00' end as posted,
    sha256(title_raw || chr(31) || description_raw || chr(31) || coalesce(location_raw, '')) as content_hash, cast(fetched_at as date) as first_seen,
    trim(regexp_replace(title_raw, ' \\(m/w/d\\)| REQ-12345| 2026 Start', '', 'g')) as title,
    case location_raw when 'Zurich / Paris' then 'CH' else coalesce(nullif(regexp_extract(want, '\\|([A-Z]*)\\|', 1), ''), '??') end as country
    from raw left join (values {_PLACE_ROWS}) v(said, want) on location_raw = said)
    select d.* exclude (posted, country), cast(posted as date) as posted_on, sha256(lower(company_slug) || chr(31) || {_KEY} || chr(31) || country || coalesce(chr(31) || cast(cast(floor(epoch(posted) / 1209600) as bigint) as varchar), '')) as fingerprint,
    role_family, seniority, min_years, phd_required, visa_sponsorship, visa_evidence, tech, languages_required from dated d join fields using (source_job_id)""",
    "raw",
)
def normalized_postings(spark, sf):
    """All that a raw record gives but places and pay, which have queries of their own."""
    p = normalized(spark, sf)
    lists = [F.array_join(c, ",").alias(c) for c in ("tech", "languages_required")]
    dates_ = [F.col("posted_at").cast("date").alias("posted_on"), F.col("first_seen_at").cast("date").alias("first_seen"), F.coalesce("min_years", F.lit(-1)).alias("min_years")]
    return p.select("source_job_id", "posting_id", "fingerprint", "source", "company_slug", "title", "title_raw", "content_hash", "role_family", "seniority", "phd_required", "visa_sponsorship", "visa_evidence", *lists, *dates_)


_REPLAYED = f"""{_FIELDS_HEAD}, fields as (select source_job_id{_FIELDS_TAIL}), was as (
        select 'j' || cast(cast(posting_id as bigint) as varchar) as source_job_id, cast(posting_id as bigint) as k, role_family, seniority, visa_sponsorship, resolver_stage from postings),
    merged as (select w.k, w.role_family as old_role, case when w.resolver_stage = 'llm' then w.role_family else f.role_family end as new_role, w.visa_sponsorship as old_visa,
        case when w.resolver_stage = 'llm' then w.visa_sponsorship else f.visa_sponsorship end as new_visa, w.seniority as old_level, case when w.resolver_stage = 'llm' or w.k % 11 = 0 then w.seniority else f.seniority end as new_level
        from was w join fields f using (source_job_id) where w.k % 3 = 0 or w.k % 7 = 0)"""


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Stored postings merged with what the rules say now, of a third that an older version made, and a seventh whose input moved since."""
    stored = _numbered(spark, sf).select(F.concat(F.lit("j"), F.col("k").cast("string")).alias("posting_id"), "k", "tier", "resolver_stage", *replay.FIELDS)
    raw = canonical(spark, sf, "raw").withColumn("posting_id", F.col("source_job_id")).withColumn("content_hash", text.content_hash(F.col("title_raw"), F.col("description_raw"), F.col("location_raw")))
    hashes_ = raw.select("posting_id", "content_hash")
    stored = stored.join(hashes_, "posting_id").withColumn("content_hash", F.when(F.col("k") % 7 == 0, F.lit("before")).otherwise(F.col("content_hash")))
    stored = stored.withColumn("normalize_version", F.when(F.col("k") % 3 == 0, 0).otherwise(normalize.VERSION))
    path = f"{shared_folder(spark)}/replay-{uuid4().hex}"
    stored.write.partitionBy("normalize_version").parquet(path)
    stored = spark.read.parquet(path)
    new = normalize.text_fields(replay.outdated(stored, raw, normalize.VERSION)).withColumn("salary_min", F.lit(None).cast("decimal(18, 4)"))
    corrected = stored.filter("k % 11 = 0").select("posting_id", F.lit("seniority").alias("field"))
    return replay.merge(stored, new, corrected)


@query(_REPLAYED + " select old_role as before, new_role as after, count(*) as n from merged group by all", "raw", "postings")
def replayed_roles(spark, sf):
    """How many postings' roles a replay moves from where to where."""
    return replay.moves(_replayed(spark, sf), "role_family")


@query(
    _REPLAYED + """ select stage, round(before, 9) as before, round(after, 9) as after, changed from (
        select 'role' as stage, avg((old_role <> 'other')::int) as before, avg((new_role <> 'other')::int) as after, count(*) filter ((old_role <> 'other') <> (new_role <> 'other')) as changed from merged
        union all select 'visa', avg((old_visa <> 'unknown')::int), avg((new_visa <> 'unknown')::int), count(*) filter ((old_visa <> 'unknown') <> (new_visa <> 'unknown')) from merged
        union all select 'seniority', avg((old_level <> 'unknown')::int), avg((new_level <> 'unknown')::int), count(*) filter ((old_level <> 'unknown') <> (new_level <> 'unknown')) from merged)""",
    "raw", "postings",
)
def replay_rates(spark, sf):
    """What share of the replayed postings each stage resolves, before and after."""
    found = replay.rates(_replayed(spark, sf)).filter("stage <> 'compensation'")
    return found.select("stage", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), "changed")


def _one_of(text_sql: str, words: tuple[str, ...]) -> str:
    return "regexp_matches(" + text_sql + ", '(^|[^a-z0-9])(" + "|".join(w.replace("+", "\\+") for w in words) + ")($|[^a-z0-9])')" if words else "false"


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words) or "null"


def _score_sql(p: Profile, as_of: str, name: str) -> str:
    """Rows r of verdicts of all postings under a profile, as the view ``name``."""
    w, topic = p.weights, p.topic_titles is not None
    inside = f"exists (select 1 from locations l where l.posting_id = p.posting_id and l.country in ({_listed(p.scope_countries)}))" if p.scope_countries else "true"
    off = f"when not (list_has_any(tech, [{_listed(p.topic_tech)}]) or {_one_of('t', p.topic_titles or ())}) then 'off_topic'" if topic else ""
    return f""", {name} as (
    with r as (select p.posting_id, p.title, lower(p.title) as t, p.role_family, p.seniority, p.min_years, p.phd_required, p.visa_sponsorship, p.salary_min, c.sector, c.priority,
        cast(floor((epoch(timestamp '{as_of}') - floor(epoch(coalesce(p.posted_at, p.first_seen_at)))) / 86400) as int) as age, coalesce((select list(tech) from tech x where x.posting_id = p.posting_id), []) as tech
        from postings p join companies c using (company_slug) where {inside}),
    w as (select *, case when {_one_of("t", p.excluded)} then 'excluded_title' when role_family = 'other' then '{"off_topic" if topic else "not_quant"}' when sector in ({_listed(p.exclude_sectors)}) then 'off_topic' {off}
        when min_years > {p.min_years_above} or {_one_of("t", p.reject_words)} then 'senior_only' when phd_required then 'phd_required' when age > {p.stale_after_days} then 'stale' end as reject,
        {_one_of("t", p.strong)} as strong, {_one_of("t", p.possible)} as possible from r),
    s as (select *, greatest(0, least(100, case when strong then {w["title_strong"]} when possible then {w["title_possible"]} else 0 end + case when priority = 1 then {w["sector_tier1"]} else 0 end
        + case when seniority in ('graduate', 'junior', 'intern') or coalesce(min_years <= {p.years_max}, false) then {w["seniority_match"]} else 0 end + case when seniority = 'graduate' then {w["graduate_programme"]} else 0 end
        + case when list_contains(tech, 'cpp') then {w["tech_cpp"]} else 0 end + case when list_contains(tech, 'python') then {w["tech_python"]} else 0 end + case when list_has_any(tech, [{_listed(p.niche_tech)}]) then {w["tech_niche"]} else 0 end
        + case visa_sponsorship when 'sponsors' then {w["visa_sponsors"]} when 'no' then {w["visa_no"]} else 0 end + case when age <= {p.window_days} then {w["freshness_7d"]} else 0 end
        + case when salary_min is not null then {w["salary_disclosed"]} else 0 end + case when age > {p.stale_after_days * p.stale_fraction} then {w["stale_penalty"]} else 0 end)) as total from w),
    z as (select *, case when reject is not null then 0 else total end as score from s)
    select posting_id, score::int as score, case when reject is not null then 'rejected' when score >= {p.tiers["strong"]} then 'strong' when score >= {p.tiers["possible"]} then 'possible' when score >= {p.tiers["stretch"]} then 'stretch' else 'rejected' end as tier,
        coalesce(reject, case when score < {p.tiers["stretch"]} then 'low_score' end) as rejection_reason from z)"""


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = store(spark, sf)
    tags = s.tech.groupBy("posting_id").agg(F.array_sort(F.collect_set("tech")).alias("tech"))
    places = s.locations.groupBy("posting_id").agg(F.collect_list(F.struct("city", "country", "region", "remote_mode")).alias("locations"))
    rows = s.postings.drop("score", "tier").join(s.companies.select("company_slug", "sector", F.col("priority").alias("rank")), "company_slug")
    rows = rows.join(tags, "posting_id", "left").join(places, "posting_id", "left")
    return rows.withColumn("tech", F.coalesce("tech", F.expr("cast(array() as array<string>)")))


_ASKED = "1998-03-01 00:00:00"
#: The profile of ``verdicts``: the default one but for a sector that is left out; and two tracks that differ from it and from each other.
_PROFILE = {"scope": {"exclude_sectors": ["MIDDLE EAST"]}}
_TRACKS = {
    "tech": {"version": 2, "topic": {"titles": ["engineer", "developer"], "tech": ["cuda", "rust"]}, "weights": {"tech_cpp": 25, "visa_no": 0}, "tiers": {"strong": 60}},
    "near": {"scope": {"countries": ["FRANCE", "GERMANY", "UNITED KINGDOM"], "exclude_sectors": []}, "hard_rejects": {"min_years_above": 3}, "seniority": {"reject": ["senior"]}},
}


@query(_score_sql(build_profile(_PROFILE), _ASKED, "judged") + " select * from judged", "postings", "companies", "tech")
def verdicts(spark, sf):
    found = score.evaluate(scored_rows(spark, sf), build_profile(_PROFILE), _ASKED)
    return found.select("posting_id", "score", "tier", "rejection_reason")


def _track_sql() -> str:
    views = "".join(_score_sql(p, _ASKED, f"judged_{name}") for name, p in build_tracks(_PROFILE, _TRACKS).items())
    rows = (
        f"""select '{name}' as track, j.posting_id, case when k.posting_id is null then j.score else k.score end as score, case when k.posting_id is null then j.tier else k.tier end as tier,
        case when k.posting_id is null then j.rejection_reason else k.rejection_reason end as rejection_reason from judged_{name} j join verdicts v on v.posting_id = j.posting_id
        left join track_verdicts k on k.track = '{name}' and k.posting_id = j.posting_id and k.profile_version = {p.version} and k.scored_at >= v.scored_at"""
        for name, p in build_tracks(_PROFILE, _TRACKS).items()
    )
    return views + " union all ".join(rows)


@query(_track_sql(), "postings", "companies", "tech", "locations", "verdicts", "track_verdicts")
def track_scores(spark, sf):
    """Verdicts of two tracks over what was judged before: kept where still current, else made anew."""
    rows = scored_rows(spark, sf).join(canonical(spark, sf, "verdicts").select("posting_id", "scored_at"), "posting_id")
    found = score.score_tracks(rows, build_tracks(_PROFILE, _TRACKS), canonical(spark, sf, "track_verdicts"), _ASKED)
    return found.select("track", "posting_id", "score", "tier", "rejection_reason")


# --- sources, batches and review ------------------------------------------------------------------


#: What a source's records carry as description: the text, nothing in a listing without texts, or the text under its heading.
_CARRIED = {
    **dict.fromkeys(("greenhouse", "lever", "ashby", "recruitee", "workable", "adzuna", "efinancialcareers"), "description_raw"), **dict.fromkeys(("smartrecruiters", "workday"), "''"), "personio": "'Tasks' || chr(10) || description_raw",
}


_RECORD = ("source_job_id", "title_raw", "location_raw", "description_raw", "url")


def _record(source: str, row: Column) -> Column:
    """One record as the source writes it."""
    job, title, place, said, url = (row[c] for c in _RECORD)
    part = lambda name: F.struct(place.alias(name))
    fields = {
        "greenhouse": {"id": job, "title": title, "absolute_url": url, "content": said, "location": part("name")},
        "lever": {"id": job, "text": title, "hostedUrl": url, "descriptionPlain": said, "categories": part("location")},
        "workday": {"externalPath": job, "title": title, "locationsText": place},
        "ashby": {"id": job, "title": title, "applyUrl": url, "location": place, "team": F.lit("t"), "descriptionHtml": said, "isListed": F.lit(True)},
        "recruitee": {"id": job, "title": title, "careers_url": url, "description": said, "locations": F.array(part("city"))},
        "smartrecruiters": {"id": job, "name": title, "ref": url, "location": part("fullLocation")},
        "workable": {"shortcode": job, "title": title, "shortlink": url, "state": place, "description": said},
        "adzuna": {"id": job, "title": title, "redirect_url": url, "description": said, "location": part("display_name"), "company": F.struct(F.lit("Employer").alias("display_name"))},
        "efinancialcareers": {"id": job, "title": title, "detailsPageUrl": url, "summary": said, "jobLocation": part("displayName"), "companyName": F.lit("Employer")},
    }[source]
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _listings(raw: DataFrame) -> DataFrame:
    """The records of each page: those of one employer and one run of keys, 64 at most.

    They are dealt by employer, once for all sources: pages and the records in them stay where they are when repeats are dropped.
    """
    page = F.floor(F.substring("source_job_id", 2, 20).cast("long") / 64).alias("page")
    rows = raw.select("company_slug", "fetched_at", *_RECORD).repartition("company_slug")
    return rows.groupBy("company_slug", page).agg(F.collect_list(F.struct(*_RECORD)).alias("listed"), F.max("fetched_at").alias("fetched_at"))


def _payloads(listings: DataFrame, source: str) -> DataFrame:
    """The listings' pages as the source writes them."""
    if source == "personio":
        tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))

        def one(row: Column) -> Column:
            text_ = tag("jobDescriptions", tag("jobDescription", F.concat(tag("name", F.lit("Tasks")), tag("value", row["description_raw"]))))
            office = F.coalesce(tag("office", row["location_raw"]), F.lit(""))
            return tag("position", F.concat(tag("id", row["source_job_id"]), tag("name", row["title_raw"]), office, text_))

        body = tag("workzag-jobs", F.array_join(F.transform("listed", one), ""))
    else:
        listed = F.transform("listed", lambda row: _record(source, row))
        path = readers.SHAPES[source][1]
        body = F.to_json(F.struct(listed.alias(path)) if path else listed)
    return listings.select("company_slug", F.col("company_slug").alias("company_name"), F.lit("t").alias("token"), body.alias("body"), "fetched_at")


@query(
    " union all ".join(
        f"""select '{source}' as source, company_slug, source_job_id, title_raw, location_raw, {"'Employer'" if source in ("adzuna", "efinancialcareers") else "company_slug"} as company_name,
        sha256(title_raw || chr(31) || {said} || chr(31) || coalesce(location_raw, '')) as content_hash from raw"""
        for source, said in _CARRIED.items()
    ),
    "raw",
)
def source_records(spark, sf):
    """Records of ten sources' payloads, read back from their JSON or XML."""
    listings, found = _listings(canonical(spark, sf, "raw")), None
    for source in _CARRIED:
        pages = _payloads(listings, source)
        rows = readers.personio(pages) if source == "personio" else readers.records(pages, source)
        rows = rows.select("source", "company_slug", "source_job_id", "title_raw", "location_raw", "company_name", "content_hash")
        found = rows if found is None else found.unionByName(rows)
    return found


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(spark, sf, "postings").withColumn("k", F.col("posting_id").cast("long"))


_AGGREGATED = ", ".join(f"'{x}'" for x in AGGREGATORS)
#: Postings of few boards under shared fingerprints; every second is stored, and of each fingerprint one comes in the batch.
_JOBS = _pick("k", (SOURCES[0], AGGREGATORS[0], SOURCES[1]))
_APPLIED = f""", jobs as (select * replace ({_JOBS} as source, 'b' || (k % 2) as company_slug) from (select *, cast(posting_id as bigint) as k from postings)),
    stored as (select * from jobs where k % 2 = 0),
    batch as (select * replace (upper(title) as title, last_seen_at + interval '1' day as last_seen_at, 'h' || cast(floor(k / 3) as bigint) % 5 as content_hash) from jobs where k % 3 = 0
        qualify row_number() over (partition by fingerprint order by k) = 1),
    near as (select b.posting_id as id, b.source in ({_AGGREGATED}) as b_agg, b.content_hash as b_hash, b.source as b_source, r.*, r.source = b.source and r.company_slug = b.company_slug as board,
        row_number() over (partition by b.posting_id order by not r.is_active, r.last_seen_at desc, r.posting_id) as place from batch b join stored r on r.fingerprint = b.fingerprint and r.is_canonical and r.posting_id <> b.posting_id),
    picked as (select id, case when any_value(b_agg) then min_by(posting_id, place) when count(*) filter (board and content_hash = b_hash) > 0 then min_by(posting_id, place) filter (board and content_hash = b_hash)
        when count(*) filter (board and is_active) > 0 then null else min_by(posting_id, place) end as best from near group by id),
    judged as (select b.posting_id, b.content_hash, s.posting_id is not null as known, coalesce(s.is_canonical, false) as was, coalesce(s.content_hash <> b.content_hash, false) as changed, r.posting_id as best,
        coalesce(b.source not in ({_AGGREGATED}) and (r.source in ({_AGGREGATED}) or not r.is_active), false) as takes, coalesce(r.content_hash = b.content_hash and r.is_active and r.source = b.source, false) as twin
        from batch b left join stored s on s.posting_id = b.posting_id left join picked p on p.id = b.posting_id left join stored r on r.posting_id = p.best),
    outcome as (select *, case when known and was then not (changed and twin) when best is null or takes then true else false end as canonical,
        case when known and was then case when changed and twin then best end when not known and best is not null and not takes then best end as alias_of,
        case when not (known and was) and best is not null and takes then best end as demoted from judged),
    rows_now as (select posting_id, title, content_hash, is_active, is_canonical and posting_id not in (select demoted from outcome where demoted is not null) as is_canonical, cast(last_seen_at as date) as last_day, cast(first_seen_at as date) as first_day
        from stored where posting_id not in (select posting_id from batch)
        union all select b.posting_id, case when o.known and not o.changed then s.title else b.title end, b.content_hash, true, o.canonical, cast(b.last_seen_at as date), cast(coalesce(s.first_seen_at, b.first_seen_at) as date)
        from batch b join outcome o using (posting_id) left join stored s on s.posting_id = b.posting_id where o.known or o.alias_of is null)"""


def _jobs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _numbered(spark, sf).withColumn("source", F.expr(_JOBS)).withColumn("company_slug", F.concat(F.lit("b"), (F.col("k") % 2).cast("string")))
    batch = rows.filter("k % 3 = 0").withColumn("__n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("k"))).filter("__n = 1").drop("__n")
    batch = batch.withColumn("title", F.upper("title")).withColumn("last_seen_at", F.col("last_seen_at") + F.expr("interval 1 day"))
    batch = batch.withColumn("content_hash", F.concat(F.lit("h"), (F.floor(F.col("k") / 3) % 5).cast("string")))
    return rows.filter("k % 2 = 0").drop("k"), batch.drop("k")


@query(_APPLIED + " select * from rows_now", "postings")
def applied_batch(spark, sf):
    """Stored postings after a batch with repeats, changes, twins, aliases and take-overs under shared fingerprints."""
    after, _ = snapshot.apply_batch(*_jobs(spark, sf))
    return after.select("posting_id", "title", "content_hash", "is_active", "is_canonical", F.col("last_seen_at").cast("date").alias("last_day"), F.col("first_seen_at").cast("date").alias("first_day"))


@query(_APPLIED + " select * from rows_now", "postings")
def batch_by_period(spark, sf):
    """The same batch applied to stored postings kept by period, of which it rewrites those it changes."""
    stored, batch = _jobs(spark, sf)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    table = periods.PeriodTable(spark, f"{shared_folder(spark)}/postings-{uuid4().hex}", columns).create(stored)
    table.apply(batch)
    after = table.read()
    return after.select("posting_id", "title", "content_hash", "is_active", "is_canonical", F.col("last_seen_at").cast("date").alias("last_day"), F.col("first_seen_at").cast("date").alias("first_day"))


@query(_APPLIED + " select posting_id as old_id, alias_of as new_id, not known as is_new from outcome where alias_of is not null union all select demoted, posting_id, false from outcome where demoted is not null", "postings")
def batch_moves(spark, sf):
    """What became an alias of what by that batch."""
    _, moves = snapshot.apply_batch(*_jobs(spark, sf))
    return moves


@query(
    """select posting_id, is_active and (cast(posting_id as bigint) % 40 = 0 or not exists (select 1 from postings s where cast(s.posting_id as bigint) % 40 = 0 and s.source = p.source and s.company_slug = p.company_slug)) as is_active
    from postings p""",
    "postings",
)
def closed_postings(spark, sf):
    """Postings that their board no longer lists are closed; boards of which nothing was seen close nothing."""
    rows = _numbered(spark, sf)
    return snapshot.deactivate_missing(rows, rows.filter("k % 40 = 0")).select("posting_id", "is_active")


@query(
    """, r as (select p.posting_id, t.description, p.visa_sponsorship, cast(0.5 + cast(p.posting_id as bigint) % 5 / 10.0 as double) as confidence from postings p join texts t using (posting_id)),
    v as (select *, confidence >= 0.55 as heard, visa_sponsorship <> 'no' as changes, case when not contains(description, 'will not sponsor') then 'visa_sponsorship: quote_not_found'
        when visa_sponsorship <> 'unknown' and confidence < 0.75 then 'visa_sponsorship: confidence_below_override' end as why from r)
    select posting_id, case when not heard then 'set_aside' when changes and why is null then 'corrected' else 'confirmed' end as outcome, case when heard and changes and why is null then visa_sponsorship end as before,
        coalesce(case when heard and changes then why end, '') as refused from v""",
    "postings", "texts",
)
def reviewed_visas(spark, sf):
    """What is taken from replies that claim a refusal of sponsorship and quote it."""
    rows = _numbered(spark, sf).join(canonical(spark, sf, "texts").select("posting_id", "description"), "posting_id").withColumn("title_raw", F.col("title"))
    none = F.lit(None)
    pay = F.struct(none.cast("decimal(18,4)").alias("amount_min"), none.cast("decimal(18,4)").alias("amount_max"), none.cast("string").alias("currency"), none.cast("string").alias("period"))
    empty = {n: none.cast("string").alias(n) for n in ("amount_min", "amount_max", "currency", "period", "pay_quote", "seniority", "level_quote", "phd_quote", "closes_on", "closes_quote")}
    replies = rows.select("posting_id", F.round(0.5 + F.col("k") % 5 / 10, 1).alias("confidence"), *empty.values(), none.cast("int").alias("min_years"), F.lit("no").alias("visa"), F.lit("We will not sponsor").alias("visa_quote"), F.lit(False).alias("phd"))
    found = review.plan(rows.withColumn("compensation", pay), replies, build_profile())
    return found.select("posting_id", "outcome", F.get("corrections", 0)["before"].alias("before"), F.array_join("refused", ",").alias("refused"))


# --- applications ----------------------------------------------------------------------------------


@query(
    f""", news as (select a.*, coalesce((select max(on_date) from application_events e where e.application_id = a.application_id), a.applied_on) as news from applications a),
    j as (select *, status in ('applied', 'interview') and news is not null and news + interval '5' month < date '1999-06-01' as abandoned from news)
    select count(*) as total, count(*) filter (status in ('applied', 'interview') and not coalesce(abandoned, false)) as open, count(*) filter (abandoned) as abandoned,
    count(*) filter (status = 'interview' or exists (select 1 from application_events e where e.application_id = j.application_id and e.status = 'interview')) as interviews,
    count(*) filter (status = 'offer') as offers, count(*) filter (status = 'rejected') as rejected, round(avg(case when status <> 'applied' then 1.0 else 0.0 end), 6) as response_rate,
    median(date_diff('day', applied_on, closed_on)) filter (status = 'rejected' and applied_on is not null and closed_on is not null) as median_days from j""",
    "applications", "application_events",
)
def application_stats(spark, sf):
    found = applications.stats(applications.with_lifecycle(canonical(spark, sf, "applications"), canonical(spark, sf, "application_events"), "1999-06-01"))
    return found.withColumn("response_rate", F.round("response_rate", 6))


@query(
    """select cv_id, count(*) as sent, count(*) filter (cv_inferred) as inferred, count(*) filter (a.status = 'interview' or exists (select 1 from application_events e where e.application_id = a.application_id and e.status = 'interview')) as interviews,
    round(avg(case when status <> 'applied' then 1.0 else 0.0 end), 6) as response_rate from applications a where cv_id is not null group by 1""",
    "applications", "application_events",
)
def cv_stats(spark, sf):
    rows = applications.with_lifecycle(canonical(spark, sf, "applications"), canonical(spark, sf, "application_events"), "1999-06-01")
    return applications.cv_stats(rows).withColumn("response_rate", F.round("response_rate", 6))


@query("select posting_id, max(application_id) as application_id from applications a where posting_id is not null group by 1", "applications")
def latest_application(spark, sf):
    return applications.latest_per_posting(canonical(spark, sf, "applications")).select("posting_id", "application_id")


@query("select conv_id::varchar as application_id, count(*) as steps, arg_max(role, turn) as status from conversations group by 1")
def latest_status(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").cast("string").alias("application_id"), F.col("turn").alias("seq"), F.col("role").alias("status"))
    return applications.latest_status(rows)


# the other modules of queries register themselves
from rowlens.plans import histories, reviews  # noqa: E402

__all__ = ["FLAGSHIP", "histories", "reviews", "oracle_sql", "queries", "query"]
