"""The canonical frames as plain SQL over the driver tables.

Every statement runs unchanged in Spark and in DuckDB: table names stand in
braces, so Spark gets them as frames and an oracle as views. Values are
deterministic in the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowlens.operators.store import Store
from rowlens.schemas import SOURCES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

#: The moment that all queries are asked at.
AS_OF = "2001-06-01 00:00:00"


def _pick(key: str, values: tuple[str | None, ...]) -> str:
    """CASE that deals values by a key's remainder."""
    cases = " ".join(f"when {k} then " + ("null" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values))
    return f"case {key} % {len(values)} {cases} end"


def _days(moment: str, key: str, days: tuple[int, ...]) -> str:
    """Moment plus days dealt by a key's remainder."""
    return f"case {key} % {len(days)} " + " ".join(f"when {k} then {moment} + interval '{d}' day" for k, d in enumerate(days)) + " end"


TITLES = (
    "Quantitative Developer", "Software Engineer", "Senior C++ Developer (m/w/d)", "Quant Trader REQ-12345", "Data Engineer", "Sales Manager",
    "Risk Analyst", "Graduate Software Engineer 2026 Start", "Site Reliability Engineer", "Quantitative Researcher", "Développeur Python", "Head of Trading Systems",
)
DESCRIPTIONS = (
    "We need 5+ years of C++ and Python. Visa sponsorship is available. Salary: $120,000 - $150,000 per year.",
    "At least 2 years of experience with Rust, Go, and Linux. You must have the right to work.",
    "A PhD is required. Fluent in French and German. The base pay is 450 EUR per day.",
    "Nous recherchons un ingénieur pour le poste. Compétences: Java, SQL. PhD preferred.",
    "We will not sponsor. 3 - 8 years of experience. Bonus and equity. Compensation: £65k - £85k a year.",
    "Wir suchen Kenntnisse in FPGA und kdb+. Bilingual German and English. Relocation support.",
    "Competitive pay, $14.6 billion in assets, remote (US only).",
)
#: Sentences of a raw description; # stands for a number that the key gives.
YEARS_SAID = ("We need #+ years of C++ and Python.", "At least # years of experience with Rust, Go, and Linux.", "A history of # years.", "# - 12 years of experience in Java or SQL.", "Work with kdb+ and Verilog.")
PAY_SAID = ("Salary: $1#0,000 - $2#0,000 per year.", "The base pay is 4#0 EUR per day.", "Compensation: £6#k - £9#k a year.", "Competitive pay.", "We manage $#4 billion in assets.", "Pay of #,500 CHF per month.", "A learning budget of €#00 per year.")
VISA_SAID = ("Visa sponsorship is available.", "You must have the right to work.", "We will not sponsor.", "Remote (US only).", "Relocation support.", "Bring your ideas.")
MORE_SAID = ("A PhD is required.", "PhD preferred.", "Fluent in French and German.", "Nous recherchons des compétences en Java.", "Wir suchen Kenntnisse in FPGA.", "Bilingual German and English.", "Bonus and equity.")
PLACES = ("London, UK", "Paris", "3 Locations", "Hybrid - New York, NY", "Remote - EMEA", "Zurich / Paris", None, "Pune, India", "Cambridge", "Plano, TX", "Dublin Ireland", "Chicago Office and Paris", "Switzerland - Zürich", "Multiple locations", "Remote (US only)", "NYC; Singapore", "Cambridge MA", "Hybrid: Berlin, Germany")
TECH = ("python", "cpp", "rust", "kdb", "java", "sql", "linux", "cuda", "fpga", "ocaml", "kubernetes", "csharp")
SHORT_TITLES = ("Software Engineer", "Quant Developer", None, "Risk Analyst", "Data Engineer")
ROLES = ("quant_dev", "swe_platform", "other", "quant_trading", "data_eng", "risk", "quant_research")
LEVELS = ("junior", "graduate", "senior", "unknown", "mid", "intern", "lead")

def _said(key: str, sentences: tuple[str, ...]) -> str:
    return f"replace({_pick(key, sentences)}, '#', cast(1 + o_orderkey % 8 as varchar(20)))"


RAW_TEXT = " || ' ' || ".join((_said("o_orderkey", YEARS_SAID), _said("o_custkey", PAY_SAID), _said("cast(floor(o_totalprice) as bigint)", VISA_SAID), _said("(o_orderkey + o_custkey)", MORE_SAID)))
ID = "lpad(cast(o_orderkey as varchar(20)), 10, '0')"
SLUG = "'s' || cast(o_custkey % (select count(*) from {supplier}) as varchar(20))"
SCORE = "cast(least(100, floor(o_totalprice / 3500)) as int)"

SQL: dict[str, str] = {
    "companies": """
        select 's' || cast(s_suppkey as varchar(20)) as company_slug, s_name as company_name, n_name as hq_country, r_name as sector,
            """ + _pick("s_suppkey", SOURCES) + """ as source, cast(1 + s_suppkey % 3 as int) as priority, s_acctbal >= 0 as enabled, s_suppkey % 10 = 0 as discovered
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "postings": f"""
        select {ID} as posting_id, {SLUG} as company_slug, {_pick("o_orderkey", SOURCES)} as source, 'j' || cast(o_orderkey as varchar(20)) as source_job_id,
            'https://jobs.example/' || cast(o_orderkey as varchar(20)) as url, {_pick("o_orderkey", TITLES)} as title,
            {_pick("o_orderkey", PLACES)} as location_raw, {SCORE} as score,
            case when {SCORE} >= 70 then 'strong' when {SCORE} >= 45 then 'possible' when {SCORE} >= 25 then 'stretch' else 'rejected' end as tier,
            {_pick("o_orderkey", ROLES)} as role_family, {_pick("o_custkey", LEVELS)} as seniority, case when o_orderkey % 4 = 0 then cast(o_orderkey % 8 as int) end as min_years,
            o_orderkey % 13 = 0 as phd_required, {_pick("o_custkey", ("sponsors", "unknown", "no"))} as visa_sponsorship, 'as written' as visa_evidence,
            case when o_orderkey % 3 = 0 then cast(50000 + o_orderkey % 100 * 1000 as decimal(18, 4)) end as salary_min, 'pay' as salary_raw,
            case when o_orderkey % 9 <> 0 then o_orderdate end as posted_at, {_days("o_orderdate", "o_orderkey", (0, 1, 2, 3, 4))} as first_seen_at,
            {_days("o_orderdate", "o_orderkey", (10, 20, 30, 40, 200))} as last_seen_at, case when o_orderkey % 6 = 0 then o_orderdate + interval '60' day end as closes_at,
            o_orderstatus <> 'F' as is_active, o_orderkey % 7 <> 0 as is_canonical, 'f' || cast(o_custkey % 400 as varchar(20)) as fingerprint,
            'h' || cast(o_orderkey % 5 as varchar(20)) as content_hash, {_pick("o_orderkey", ("rules", "llm", "rules"))} as resolver_stage
        from {{orders}}""",
    "locations": f"""
        select {ID} as posting_id, n_name as country, case when o_orderkey % 11 <> 0 then n_name || '-' || cast(o_orderkey % 4 as varchar(20)) end as city,
            r_name as region, {_pick("o_orderkey", ("onsite", "hybrid", "remote", "unknown"))} as remote_mode
        from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
        union all
        select {ID}, n_name, n_name || '-x', r_name, 'remote'
        from {{orders}} join {{nation}} on o_orderkey % 25 = n_nationkey join {{region}} on n_regionkey = r_regionkey where o_orderkey % 3 = 0""",
    "tech": f"select distinct lpad(cast(l_orderkey as varchar(20)), 10, '0') as posting_id, {_pick('l_partkey', TECH)} as tech from {{lineitem}} where l_orderkey % 8 <> 5",
    "verdicts": f"""
        select {ID} as posting_id, {SCORE} as score, case when {SCORE} >= 70 then 'strong' when {SCORE} >= 45 then 'possible' when {SCORE} >= 25 then 'stretch' else 'rejected' end as tier,
            case when {SCORE} < 25 then {_pick("o_custkey", ("low_score", "not_quant", "senior_only", "stale"))} end as rejection_reason,
            {_days("o_orderdate", "o_orderkey", (5, 6))} as scored_at
        from {{orders}}""",
    "track_verdicts": f"""
        select 'tech' as track, {ID} as posting_id, cast(o_orderkey * 7 % 101 as int) as score,
            case when o_orderkey * 7 % 101 >= 70 then 'strong' when o_orderkey * 7 % 101 >= 45 then 'possible' when o_orderkey * 7 % 101 >= 25 then 'stretch' else 'rejected' end as tier,
            case when o_orderkey * 7 % 101 < 25 then 'off_topic' end as rejection_reason, cast(1 + o_orderkey % 2 as int) as profile_version, {_days("o_orderdate", "o_orderkey", (4, 7))} as scored_at
        from {{orders}} where o_orderkey % 2 = 0""",
    "flags": f"""
        select {ID} as posting_id, o_orderkey % 3 = 0 as is_favorite, o_orderkey % 11 = 0 as is_hidden, {_pick("o_orderkey", ("no", None, "maybe", None, None))} as triage,
            {_pick("o_orderkey", ("applied", None, None, "interview", None, "rejected", None))} as application_status, 'note' as note
        from {{orders}} where o_custkey % 5 = 0""",
    "texts": f"""
        select {ID} as posting_id, {_pick("o_orderkey", TITLES)} as title, {SLUG} as company_name, {_pick("o_orderkey", TECH)} as tech, {_pick("o_orderkey", DESCRIPTIONS)} as description
        from {{orders}}""",
    "raw": f"""
        select {_pick("o_orderkey", SOURCES)} as source, {SLUG} as company_slug, 'j' || cast(o_orderkey as varchar(20)) as source_job_id, 'https://jobs.example/' || cast(o_orderkey as varchar(20)) as url,
            {_pick("o_orderkey", TITLES)} as title_raw, {RAW_TEXT} as description_raw, {_pick("o_orderkey", PLACES)} as location_raw,
            {_pick("o_orderkey", ("2001-02-03", "2001-02-03T10:00:00Z", "soon", None, "1712031231230"))} as posted_at_raw, o_orderdate as fetched_at
        from {{orders}}""",
    "runs": f"""
        select 'r' || lpad(cast(event_id as varchar(20)), 10, '0') as run_id, {_pick("user_id", SOURCES[:7])} as source, case when event_id % 3 <> 0 then 's' || cast(user_id as varchar(20)) end as company_slug,
            ts as started_at, ts + interval '1' minute as ended_at, cast(case when event_id % 5 = 1 then 0 else floor(value) end as int) as fetched, cast(event_id % 7 as int) as new, cast(event_id % 3 as int) as updated,
            0 as aliased, 0 as rejected, {_pick("event_id", ("ok", "empty", "error", "blocked", "skipped", "error", "ok", "error", "error"))} as status
        from {{events}}""",
    "applications": f"""
        select 'a' || lpad(cast(o_orderkey as varchar(20)), 10, '0') as application_id, 'c' || cast(o_custkey % 50 as varchar(20)) as company, {_pick("o_orderkey", TITLES)} as title,
            case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) end as applied_on, case when o_orderkey % 5 = 2 then cast(o_orderdate + interval '21' day as date) end as closed_on,
            {_pick("o_orderkey", ("applied", "interview", "rejected", "applied", "offer"))} as status, case when o_orderkey % 3 = 0 then {ID} end as posting_id, {_pick("o_orderkey", ("cv1", "cv2", None))} as cv_id,
            o_orderkey % 4 = 0 as cv_inferred
        from {{orders}} where o_orderkey % 6 = 1 or o_orderkey % 10 = 0""",
    "application_events": f"""
        select 'a' || lpad(cast(o_orderkey as varchar(20)), 10, '0') as application_id, 0 as seq, cast(o_orderdate as date) as on_date, 'applied' as status from {{orders}} where (o_orderkey % 6 = 1 or o_orderkey % 10 = 0) and o_orderkey % 17 <> 0
        union all
        select 'a' || lpad(cast(o_orderkey as varchar(20)), 10, '0'), 1, cast(o_orderdate + interval '9' day as date), 'interview' from {{orders}} where (o_orderkey % 6 = 1 or o_orderkey % 10 = 0) and o_orderkey % 3 = 1""",
    # orders that follow each other share their fields, so that rows repeat and tie
    "sheet": f"""
        select 'r' || {ID} as row_id, 'c' || cast(g % (select count(*) from {{customer}}) as varchar(20)) as company, {_pick("g", SHORT_TITLES)} as title, {_pick("g", ("London", None, "Paris", "Chicago"))} as location,
            case when g % 9 <> 4 then cast(timestamp '1998-01-01 00:00:00' as date) + cast(g * 7 % 90 as int) end as applied_on, cast(null as date) as closed_on, case when g % 4 = 1 then 'failed' else '' end as reason
        from (select o_orderkey, o_custkey, cast(floor(o_orderkey / 7) as bigint) as g from {{orders}}) o where o_orderkey % 3 = 1""",
    "folders": f"""
        select 'f' || {ID} as folder_id, 'c' || cast(g % (select count(*) from {{customer}}) as varchar(20)) as company, {_pick("h", ("Software Engineer Paris", "Data Engineer", "Quant Developer London", "Risk Analyst", "Software Engineer"))} as title,
            case when h % 11 <> 3 then cast(timestamp '1998-01-01 00:00:00' as date) + cast(h * 5 % 90 as int) end as day, h % 5 = 0 as estimated, 'p/' || {ID} as relative
        from (select o_orderkey, cast(floor(o_orderkey / 7) as bigint) as g, cast(floor(o_orderkey / 3) as bigint) as h from {{orders}}) o where o_orderkey % 5 < 2""",
}


def canonical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical frame; only the tables that it uses are read."""
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]})


def store(spark: SparkSession, sf_dir: str) -> Store:
    names = ("postings", "companies", "locations", "tech", "verdicts", "track_verdicts", "flags", "texts")
    used = {t for t in TABLES for n in names if "{" + t + "}" in SQL[n]}
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return Store(**{n: spark.sql(SQL[n], **{t: f for t, f in tables.items() if "{" + t + "}" in SQL[n]}) for n in names})


def oracle(body: str, *names: str) -> str:
    """DuckDB statement with the canonical frames that ``body`` names."""
    views = {t: t for t in TABLES}
    ctes = ",\n".join(f"{n} as ({SQL[n].format(**views)})" for n in names)
    return f"with recursive {ctes}\n{body}" if ctes else body
