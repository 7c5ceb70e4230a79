"""Operators that SQL can't state: against hand-made cases and their sequential meaning."""

import hashlib
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowlens.config import build_profile
from rowlens.operators import applications, dedup, export, feed, health, replay, resolve, review, score, search, snapshot
from rowlens.plans.projection import AS_OF, canonical, store
from rowlens.sources import history, pages, readers
from tests.conftest import SMALL

T0 = datetime(2026, 1, 1)


def test_pages_neither_overlap_nor_skip(spark):
    s = store(spark, SMALL)
    want = [r.posting_id for r in feed.base_feed(s).orderBy(*feed.order("closes")).collect()]
    got, cursor = [], None
    while True:
        rows, cursor = feed.page(s, sort="closes", cursor=cursor, limit=100)
        got += [r.posting_id for r in rows]
        if cursor is None:
            break
    assert got == want
    with pytest.raises(feed.CursorError):
        feed.decode_cursor("nonsense")


def test_detail_and_url(spark):
    s = store(spark, SMALL)
    one = s.postings.first()
    aliases = spark.createDataFrame([(one.posting_id, "indeed", "x", "https://alias", T0)], "canonical_id string, source string, source_job_id string, url string, seen_at timestamp")
    fixes = spark.createDataFrame([(1, one.posting_id, one.content_hash, "visa_sponsorship", "unknown", "no")], "correction_id int, posting_id string, content_hash string, field string, before string, after string")
    row = feed.detail(s, one.posting_id, aliases, fixes, "tech").first()
    assert row.aliases[0].url == "https://alias" and row.corrections[0].field == "visa_sponsorship"
    assert feed.id_by_url(s.postings, aliases, "https://alias").first().posting_id == one.posting_id


def test_search_never_fails(spark):
    texts = spark.createDataFrame([("1", "Ingénieur C++", "Société", "cpp", "low latency trading"), ("2", "Trader", "Acme", "", "latency low")], "posting_id string, title string, company_name string, tech string, description string")

    def ids(**k):
        return [r.posting_id for r in search.matching(texts, search.Match(**k)).orderBy("posting_id").collect()]

    assert ids(every=("ingenieur",)) == ["1"] and ids(phrases=("low latency",)) == ["1"] and ids(prefixes=("trad",)) == ["1", "2"]
    assert ids(every=("latency",), none=("acme",)) == ["1"] and ids(any=("acme", "zzz")) == ["2"]
    assert ids(every=('"((',)) == [] and ids() == []
    assert search.token_table(texts).filter("word = 'societe'").count() == 1


def test_duplicates_merge_once(spark):
    s = store(spark, SMALL)
    none = spark.createDataFrame([], "canonical_id string, source string, source_job_id string, url string, seen_at timestamp")
    apps = canonical(spark, SMALL, "applications")
    moves = dedup.demotions(dedup.duplicate_members(s))
    n = moves.count()
    after, aliases, _ = dedup.demote(s, none, apps, moves)
    assert n > 0 and aliases.count() == n
    assert s.postings.filter("is_canonical").count() - after.postings.filter("is_canonical").count() == n
    assert dedup.demotions(dedup.duplicate_members(after)).count() == 0
    assert after.flags.count() <= s.flags.count()


def test_chains(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old_id string, new_id string")
    assert {(r.old_id, r.new_id) for r in dedup.settle_chains(moves).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}


POSTING = "posting_id string, fingerprint string, source string, company_slug string, source_job_id string, content_hash string, title string, is_canonical boolean, is_active boolean, first_seen_at timestamp, last_seen_at timestamp"


def test_batches(spark):
    day = timedelta(days=1)
    stored = spark.createDataFrame(
        [
            ("p1", "f1", "lever", "acme", "1", "h1", "old", True, True, T0, T0), ("p2", "f2", "indeed", "acme", "2", "h2", "agg", True, True, T0, T0),
            ("p3", "f3", "lever", "acme", "3", "h3", "closed", True, False, T0, T0), ("p4", "f4", "lever", "acme", "4", "h4", "same", True, True, T0, T0),
        ],
        POSTING,
    )
    batch = spark.createDataFrame(
        [
            ("p1", "f1", "lever", "acme", "1", "h1x", "new", True, True, T0 + day, T0 + day), ("n2", "f2", "lever", "acme", "22", "h2", "real", True, True, T0 + day, T0 + day),
            ("n3", "f3", "lever", "acme", "33", "h33", "again", True, True, T0 + day, T0 + day), ("n4", "f4", "lever", "acme", "44", "h4", "copy", True, True, T0 + day, T0 + day),
            ("n5", "f4", "lever", "acme", "55", "h5", "sibling", True, True, T0 + day, T0 + day), ("n6", "f1", "indeed", "x", "66", "h6", "agg of p1", True, True, T0 + day, T0 + day),
        ],
        POSTING,
    )
    got, moves = snapshot.apply_batch(stored, batch)
    rows = {r.posting_id: r for r in got.collect()}
    assert rows["p1"].title == "new" and rows["p1"].first_seen_at == T0 and rows["p1"].last_seen_at == T0 + day
    assert not rows["p2"].is_canonical and rows["n2"].is_canonical  # a board takes over from an aggregator
    assert not rows["p3"].is_canonical and rows["n3"].is_canonical  # and from a closed posting
    assert rows["n5"].is_canonical and "n4" not in rows and "n6" not in rows
    assert {(r.old_id, r.new_id) for r in moves.collect()} == {("p2", "n2"), ("p3", "n3"), ("n4", "p4"), ("n6", "p1")}
    again, none = snapshot.apply_batch(got, batch.filter("posting_id in ('p1', 'n2', 'n3', 'n5')"))
    assert {r.posting_id: r.is_canonical for r in again.collect()} == {k: r.is_canonical for k, r in rows.items()} and none.count() == 0
    seen = spark.createDataFrame([("lever", "acme", "1")], "source string, company_slug string, source_job_id string")
    left = {r.posting_id: r.is_active for r in snapshot.deactivate_missing(got, seen).collect()}
    assert left["p1"] and not left["n5"] and left["p2"]
    assert snapshot.deactivate_missing(got, seen.limit(0)).filter("is_active").count() == got.filter("is_active").count()


def test_marks_and_companies(spark):
    flags = spark.createDataFrame([("1", True, None)], "posting_id string, is_favorite boolean, triage string")
    change = spark.createDataFrame([("1", "no"), ("2", "maybe")], "posting_id string, triage string")
    assert {tuple(r) for r in snapshot.merge_marks(flags, change).collect()} == {("1", True, "no"), ("2", None, "maybe")}
    companies = spark.createDataFrame([("a", "A", "lever", True, False), ("d", "D", "indeed", False, True)], "company_slug string, company_name string, source string, enabled boolean, discovered boolean")
    registry = spark.createDataFrame([("d", "Dee", "lever", True)], "company_slug string, company_name string, source string, enabled boolean")
    assert [(r.company_slug, r.discovered) for r in snapshot.sync_companies(companies, registry).collect()] == [("d", False)]


def test_resolution(spark):
    day = date(2026, 3, 1)
    rows = spark.createDataFrame(
        [("r1", "Alpha Capital", "Quant Dev", "London", day, None, ""), ("r2", "Alpha", "Data Engineer", "Paris", day, date(2026, 4, 1), "failed interview"), ("r3", "Beta", "Dev", "", day, None, ""), ("r4", "Zeta", None, "", None, None, "no")],
        "row_id string, company string, title string, location string, applied_on date, closed_on date, reason string",
    )
    folders = spark.createDataFrame(
        [("f1", "Alpha", "Quant Developer London", day, True, "Alpha/Quant Developer London"), ("f2", "Alpha", "Data Eng", day, False, "Alpha/Data Eng"), ("f3", "Beta", "Dev", day, False, "Beta/1"), ("f4", "Beta", "Dev", day, False, "Beta/2"), ("f5", "Gamma", None, day, True, "Gamma")],
        "folder_id string, company string, title string, day date, estimated boolean, relative string",
    )
    registry = spark.createDataFrame([("alpha", "alpha_slug")], "company_key string, company_slug string")
    got = resolve.reconcile(rows, folders, registry).collect()
    by = {(r.company, r.dossier): r for r in got}
    assert by["Alpha Capital", "Alpha/Quant Developer London"].outcome == "paired" and by["Alpha", "Alpha/Data Eng"].company_slug == "alpha_slug"
    assert [e.status for e in by["Alpha", "Alpha/Data Eng"].events] == ["applied", "interview", "rejected"]
    assert by["Beta", None].outcome == "ambiguous" and by["Beta", None].candidates == ["f3", "f4"]
    assert by["Zeta", None].outcome == "sheet_only" and by["Gamma", "Gamma"].outcome == "folder_only"
    assert len({r.application_id for r in got}) == len(got)


def test_feed_links(spark):
    day = date(2026, 3, 1)
    posts = spark.createDataFrame([("p1", "alpha", "Alpha Capital", "Quant Developer", "London", day), ("p2", "beta", "Beta", "Trader", "", day)], "posting_id string, company_slug string, company_name string, title string, places string, day date")
    apps = spark.createDataFrame(
        [("a1", "Alpha", None, "Quant Dev", "London", date(2026, 3, 4), "applied", "", None), ("a2", "Alpha", None, "Quant Dev", "London", date(2026, 3, 9), "applied", "", None), ("a3", "Beta", "beta", "Trader", "", day, "applied", "", None), ("a4", "Beta", "beta", "Trader", "", day, "rejected", "", None)],
        "application_id string, company string, company_slug string, title string, location string, applied_on date, status string, reason string, posting_id string",
    )
    got = {r.posting_id: r for r in resolve.link_postings(resolve.link_candidates(posts, apps)).collect()}
    assert got["p1"].application_id == "a1" and got["p2"].application_id is None and sorted(got["p2"].ambiguous) == ["a3", "a4"]


def test_review(spark):
    posting = spark.createDataFrame(
        [("1", "Quant Dev", "London", "Base salary 150k to 180k USD per year. We cannot sponsor visas. Apply by 23 December 2026. A PhD is required.", None, "unknown", None, "unknown", False, None, T0)],
        "posting_id string, title_raw string, location_raw string, description string, compensation struct<amount_min:decimal(18,4),amount_max:decimal(18,4),currency:string,period:string,bonus_mentioned:boolean,equity_mentioned:boolean,raw:string>, seniority string, min_years int, visa_sponsorship string, phd_required boolean, closes_at timestamp, first_seen_at timestamp",
    )
    schema = "posting_id string, confidence double, amount_min string, amount_max string, currency string, period string, pay_quote string, seniority string, min_years int, level_quote string, visa string, visa_quote string, phd boolean, phd_quote string, closes_on string, closes_quote string"
    good = ("1", 0.9, "150000", "180000", "USD", "year", "Base salary 150k to 180k USD per year", "senior", None, "Quant Dev", "no", "We cannot sponsor visas", True, "A PhD is required", "2026-12-23", "Apply by 23 December 2026")
    r = review.plan(posting, spark.createDataFrame([good], schema), build_profile()).first()
    assert r.outcome == "corrected" and [c.field for c in r.corrections] == ["compensation", "visa_sponsorship", "phd_required", "closes_at"]
    assert r.refused == ["seniority: level_not_quoted"]
    bad = good[:2] + ("160000",) + good[3:10] + ("sponsors", "visa help", True, "PhD or equivalent required", "2025-12-23", "Apply by 23 December 2026")
    r = review.plan(posting, spark.createDataFrame([bad], schema), build_profile()).first()
    assert r.outcome == "confirmed" and len(r.refused) == 5
    low = ("1", 0.3) + good[2:]
    assert review.plan(posting, spark.createDataFrame([low], schema), build_profile()).first().outcome == "set_aside"
    queue = spark.createDataFrame([("1", False, T0, 2)], "posting_id string, urgent boolean, queued_at timestamp, attempts int")
    new = spark.createDataFrame([("1", True, T0 + timedelta(days=1)), ("2", False, T0)], "posting_id string, urgent boolean, queued_at timestamp")
    assert [tuple(r) for r in review.next_in_queue(review.enqueue(queue, new), 5).collect()] == [("1", True, T0, 2), ("2", False, T0, 0)]


def test_tracks_and_prefilter(spark):
    from rowlens.plans.catalog import scored_rows

    rows = scored_rows(spark, SMALL).withColumn("scored_at", F.lit(AS_OF).cast("timestamp"))
    tracks = {"tech": build_profile({"version": 2, "topic": {"titles": ["c++"], "tech": ["cuda"]}, "scope": {"countries": ["NATION_1", "NATION_2"]}})}
    got = score.score_tracks(rows, tracks, canonical(spark, SMALL, "track_verdicts"), AS_OF)
    inside = rows.filter(score.in_scope(tracks["tech"])).count()
    assert got.count() == inside > 0 and got.filter("(tier = 'rejected') <> (rejection_reason is not null)").count() == 0
    again = score.score_tracks(rows, tracks, got, AS_OF)
    assert again.exceptAll(got).count() == 0
    judged = score.evaluate(rows, build_profile(), AS_OF).withColumn("description", F.lit("d" * 300))
    found = judged.select(score.is_ambiguous(build_profile()).alias("a"), score.is_urgent(build_profile()).alias("u"), "rejection_reason")
    assert found.filter("a and rejection_reason not in ('not_quant')").count() == found.filter("a and rejection_reason is not null and rejection_reason <> 'not_quant'").count() == 0


def test_replay_gate(spark):
    s = store(spark, SMALL)
    old = s.postings
    worse = old.withColumn("seniority", F.lit("unknown"))
    none = spark.createDataFrame([], "posting_id string, field string")
    merged = replay.merge(old, worse, none)
    assert replay.regressions(replay.rates(merged)).filter("stage = 'seniority'").count() == 1
    with pytest.raises(replay.RegressionError):
        replay.gated(merged)
    assert replay.gated(replay.merge(old, old, none)).count() == 0
    kept = replay.merge(old, worse, old.select("posting_id", F.lit("seniority").alias("field")))
    assert replay.changed(kept).count() == 0
    assert replay.transitions(old, old).filter("before <> after").count() == 0


def test_health_snapshot(spark):
    companies, runs = canonical(spark, SMALL, "companies"), canonical(spark, SMALL, "runs")
    got = health.snapshot(companies, runs, "2024-03-01 00:00:00", {"greenhouse": 60}).collect()
    assert {r.status for r in got} <= {"ok", "degraded", "disabled", "unknown"} and len(got) == companies.select("source").distinct().count()
    assert health.feed_health(canonical(spark, SMALL, "postings"), AS_OF).count() == 1


def test_application_writes(spark):
    events = spark.createDataFrame([("a", 0, date(2026, 1, 1), "applied")], "application_id string, seq int, on_date date, status string")
    new = spark.createDataFrame([("a", date(2026, 2, 1), "interview", 1), ("b", date(2026, 2, 1), "applied", 1)], "application_id string, on_date date, status string, order int")
    got = applications.append_events(events, new)
    assert {(r.application_id, r.seq, r.status) for r in got.collect()} == {("a", 0, "applied"), ("a", 1, "interview"), ("b", 0, "applied")}
    apps = canonical(spark, SMALL, "applications")
    rows = applications.with_lifecycle(apps, canonical(spark, SMALL, "application_events"), "1999-06-01").withColumn("countries", F.array(F.lit("FR"), F.lit("DE"), F.lit("FR")))
    assert applications.view(rows, "open", text="DÉVELOPPEUR").count() == rows.filter("is_open and title like 'Développeur%'").count()
    assert [r.country for r in applications.country_counts(rows).collect()] == ["DE", "FR"]
    assert applications.sorted_view(rows, "delay", "1999-06-01", True).count() == rows.count()
    cvs = spark.createDataFrame([("c", "mine", True, T0)], "cv_id string, label string, pinned boolean, created_at timestamp")
    again = spark.createDataFrame([("c", "other", False, T0 + timedelta(days=1))], "cv_id string, label string, pinned boolean, created_at timestamp")
    assert tuple(applications.cv_registry(cvs, again).first()) == ("c", "mine", True, T0)
    links = applications.mirror_status(spark.createDataFrame([("p", True, None)], "posting_id string, is_favorite boolean, application_status string"), spark.createDataFrame([("a1", "p", "applied"), ("a2", "p", "offer")], "application_id string, posting_id string, status string"))
    assert tuple(links.first()) == ("p", True, "offer")


def test_export(spark, tmp_path):
    s = store(spark, SMALL)
    rows = export.flat_feed(s)
    export.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == rows.count() > 0
    queue = spark.createDataFrame([(1,)], "attempts int")
    assert all(f.count() >= 0 for f in export.weekly_report(s, queue, AS_OF).values())


PAGE = "company_slug string, company_name string, token string, body string, fetched_at timestamp"


def test_sources(spark):
    def got(source, body):
        df = spark.createDataFrame([("acme", "Acme", "acme", body, T0)], PAGE)
        return [r.asDict() for r in (readers.personio(df) if source == "personio" else readers.records(df, source)).orderBy("source_job_id").collect()]

    g = got("greenhouse", '{"jobs":[{"id":1,"title":"Dev","absolute_url":"u","location":{"name":"Paris"},"content":"c","departments":[{"name":"IT"}],"updated_at":"2026-01-01"},{"id":2,"title":""}]}')
    assert len(g) == 1 and g[0]["location_raw"] == "Paris" and g[0]["department_raw"] == "IT" and g[0]["source_job_id"] == "1"
    a = got("ashby", '{"jobs":[{"id":"a","title":"T","jobUrl":"","applyUrl":"v","descriptionPlain":"","descriptionHtml":"<p>","team":"X"},{"id":"b","title":"T","jobUrl":"v","isListed":false}]}')
    assert len(a) == 1 and a[0]["description_raw"] == "<p>" and a[0]["url"] == "v" and a[0]["department_raw"] == "X"
    assert got("lever", '[{"id":"l","text":"T","hostedUrl":"h","categories":{"location":"NY","team":""},"opening":"o","createdAt":1712031231230}]')[0]["posted_at_raw"] == "1712031231230"
    assert got("recruitee", '{"offers":[{"id":3,"title":"T","careers_url":"c","locations":[{"name":"A"},{"city":"B"}]}]}')[0]["location_raw"] == "A; B"
    assert got("workable", '{"jobs":[{"title":"T","shortcode":"s","url":"u","city":"X","state":"","country":"Y","created_at":"d"}]}')[0]["location_raw"] == "X, Y"
    xml = "<workzag-jobs><position><id>7</id><name>Dev</name><office>Berlin</office><jobDescriptions><jobDescription><name>N</name><value>V</value></jobDescription><jobDescription><name>E</name><value> </value></jobDescription></jobDescriptions></position></workzag-jobs>"
    assert got("personio", xml)[0]["description_raw"] == "N\nV"
    bad = spark.createDataFrame([("acme", "Acme", "acme", '{"other":1}', T0)], PAGE)
    assert readers.malformed(bad, "greenhouse").count() == 1
    with pytest.raises(readers.SchemaChanged):
        readers.checked(bad, "greenhouse")
    w = spark.createDataFrame([("acme", "Acme", "acme", '{"total":1,"jobPostings":[{"title":"Dev","externalPath":"/job/Pune-India/x","locationsText":"3 Locations"}]}', T0)], PAGE)
    assert readers.workday_places(readers.records(w, "workday")).first().location_raw == "Pune India"
    body = '{"data":{"jobs":[{"id":5,"name":"T","link":"u","tags":[{"k":"city","v":"Paris"},{"k":"x","v":"no"}],"places":[{"c":"A"},{"c":"B"},{"c":"A"}]}]}}'
    c = spark.createDataFrame([("acme", "Acme", "acme", body, T0)], PAGE)
    one = readers.custom_endpoint(c, "data.jobs", {"id": ("id",), "title": ("name",), "url": ("link",), "location": ("places.c", "tags.k=city.v")}).first()
    assert (one.source_job_id, one.location_raw) == ("5", "A, B, Paris")
    assert c.select(readers.is_challenge(F.lit("... Just a Moment ...")).alias("x")).first().x
    companies = spark.createDataFrame([("jane_doe", "Jane Doe Ltd.")], "company_slug string, company_name string")
    raws = spark.createDataFrame([("", "JANE DOE LLC"), ("", "New Firm Inc")], "company_slug string, company_name string")
    assert sorted(r.company_slug for r in readers.resolve_employers(raws, companies).collect()) == ["jane_doe", "new_firm"]


def test_rendered_pages(spark):
    html = "<main><h1>Head <b>x</b></h1>" + "<p>word</p>" * 60 + "</main><a href='/jobs/12'> Quant  Dev </a><a href='/about'>About</a><a href='/jobs/12?x'>Quant Dev</a>"
    df = spark.createDataFrame([(1, "acme", html)], "page_id long, company_slug string, body string")
    assert [tuple(r) for r in pages.listing(df, r"/jobs/(\d+)").collect()] == [("acme", "12", "/jobs/12", "Quant Dev")]
    r = pages.texts(df, html_col="body").first()
    assert r.heading == "Head x" and r.text.count("word") == 60
    assert pages.texts(spark.read.parquet(f"{SMALL}/pages.parquet")).filter("text like '%<script%'").count() == 0


def test_histories(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Country,Company,Job,Application date,Rejection date,Reason,,Country,Company,Application date,Rejection date,Reason\nJanuary,,,,,,,,,,,\nUK,Acme,"Quant\nDev",01/02/2026,,Waiting,,FR,Beta,?,03/04/2026,no\n2,,,,,,,1,,,,\nUK,,x,01/02/2026,,,,FR,Gamma,31/02/2026,,\n')
    rows, issues = history.sheet_rows(history.read_sheets(spark, str(tmp_path / "s.csv")))
    assert {(r.company, r.title, str(r.applied_on), str(r.closed_on)) for r in rows.collect()} == {("Acme", "Quant Dev", "2026-02-01", "None"), ("Beta", None, "None", "2026-04-03")}
    assert sorted(r.message for r in issues.collect()) == ["no company", "unreadable date"]
    files = spark.createDataFrame(
        [("Acme/Quant Dev/offer.png", T0), ("Acme/Quant Dev/cv.pdf", T0 + timedelta(days=3)), ("Acme/cv.pdf", T0), ("Beta/12-03-2026/a.png", T0), ("Solo.png", T0), ("Archive/x/a.png", T0), ("Acme/notes.md", T0)], "path string, modified timestamp"
    )
    got = {r.folder_id: r for r in history.folder_entries(files).collect()}
    assert set(got) == {"Acme/Acme/Quant Dev", "Beta/Beta/12-03-2026", "Solo/"}
    assert got["Acme/Acme/Quant Dev"].inherited == ["Acme/cv.pdf"] and got["Acme/Acme/Quant Dev"].title == "Quant Dev"
    assert got["Beta/Beta/12-03-2026"].day == date(2026, 3, 12) and not got["Beta/Beta/12-03-2026"].estimated


def test_streams_equal_batches(spark, tmp_path):
    from rowlens.streaming import ingest

    raw = canonical(spark, SMALL, "raw").limit(300).withColumn("content_hash", F.sha2("title_raw", 256))
    raw.write.parquet(str(tmp_path / "in"))
    kept = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kept.schema).parquet(str(tmp_path / "in"))
    q = ingest.ingest(stream, str(tmp_path / "archive"), str(tmp_path / "postings")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    from rowlens.operators.normalize import normalize

    got = spark.read.parquet(str(tmp_path / "postings")).drop("batch")
    assert got.select("posting_id", "role_family").exceptAll(normalize(kept).select("posting_id", "role_family")).count() == 0 and got.count() == 300
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 300


def test_tracking_postings(spark):
    apps = spark.createDataFrame(
        [("a1", "p1", "applied", "Acme", None, "T", None, datetime(2026, 1, 1).date(), None, "feed", None, False), ("a2", None, "interview", "Beta", None, "T", None, None, None, "import", None, False), ("a3", "p3", "applied", "Gamma", None, "T", None, None, None, "import", None, False)],
        "application_id string, posting_id string, status string, company string, company_slug string, title string, location string, applied_on date, closed_on date, origin string, cv_id string, cv_inferred boolean",
    )
    events = spark.createDataFrame([("a1", 0, datetime(2026, 1, 1).date(), "applied"), ("a2", 0, datetime(2026, 1, 2).date(), "interview")], "application_id string, seq int, on_date date, status string")
    schema = "posting_id string, status string, company string, company_slug string, title string, location string"
    wish = lambda *rows: spark.createDataFrame([(p, s, "C", "c", "T", None) for p, s in rows], schema)
    links = spark.createDataFrame([("p2", "a2")], "posting_id string, application_id string")
    after, history = applications.track_postings(apps, events, wish(("p1", "rejected"), ("p2", "interview"), ("p4", "interview"), ("p3", None), ("p9", None)), links, "2026-02-01", "cv1")
    got = {r.posting_id or r.application_id: r for r in after.collect()}
    assert len(got) == 4 and got["p1"].status == "rejected" and str(got["p1"].closed_on) == "2026-02-01" and got["p2"].application_id == "a2" and got["a3"].status == "applied"
    assert got["p4"].origin == "feed" and got["p4"].cv_id == "cv1" and got["p4"].status == "interview"
    steps = {}
    for r in history.orderBy("application_id", "seq").collect():
        steps.setdefault(r.application_id, []).append(r.status)
    assert steps == {"a1": ["applied", "rejected"], "a2": ["interview"], got["p4"].application_id: ["applied", "interview"]}
    after, history = applications.track_postings(apps, events, wish(("p1", None)), links, "2026-02-01")
    assert {r.application_id for r in after.collect()} == {"a2", "a3"} and {r.application_id for r in history.collect()} == {"a2"}


def test_small_surfaces(spark):
    from rowlens.config import ConfigError, build_sources, query_boards
    from rowlens.functions.text import description_blocks

    made = build_sources({"defaults": {"timeout_s": 5}, "sources": {"lever": {"enabled": False, "interval_min": 30}}}, ("lever", "ashby"))
    assert not made["lever"].enabled and made["lever"].interval_minutes == 30 and made["ashby"].enabled and made["ashby"].timeout_seconds == 5
    with pytest.raises(ConfigError):
        build_sources({"sources": []}, ("lever",))
    assert [r["token"] for r in query_boards({"x": {"queries": ["a", "b"]}, "y": {"queries": ["c"]}}, {"y": False})] == ["a", "b"]
    text = "ABOUT US\nWe trade.\n\nYou will:\n- build\n- test\n\n- alone\nThe end"
    got = spark.createDataFrame([(text,)], "t string").select(description_blocks(F.col("t")).alias("b")).first().b
    assert [(b.kind, b.lines) for b in got] == [("heading", ["ABOUT US"]), ("paragraph", ["We trade."]), ("heading", ["You will:"]), ("list", ["build", "test"]), ("list", ["alone"]), ("paragraph", ["The end"])]


def test_cycle_gate_probe_and_walls(spark):
    """Open breakers ask nothing, half-open ones one board, a block ends a source's cycle unless its boards have hosts of their own."""
    boards = [(s, f"{s}{k}", 1, k != 9) for s in ("lever", "ashby", "workday", "custom", "personio", "workable") for k in range(10)] + [("wttj", "w", 3, True)]
    companies = spark.createDataFrame(boards, "source string, company_slug string, priority int, enabled boolean")
    at = lambda m: datetime(2024, 1, 1, 11, m)
    log = [("1", "ashby", None, "blocked", at(59)), ("2", "custom", None, "blocked", at(0)), ("3", "lever", None, "error", at(1)), ("4", "wttj", "w", "ok", at(2)), ("5", "ashby", None, "skipped", at(59))]
    runs = spark.createDataFrame([(i, s, c, st, t, t, 1) for i, s, c, st, t in log], "run_id string, source string, company_slug string, status string, started_at timestamp, ended_at timestamp, fetched int")
    now = "2024-01-01 11:59:20"
    plan = health.plan_cycle(companies, runs, now, "a")
    asked = plan.toPandas()
    counts = asked.groupby("source").size().to_dict()
    assert counts == {"lever": 9, "workday": 9, "custom": 1, "personio": 9, "workable": 9}
    first = {s: min((hashlib.md5(f"a:{s}:{c}".encode()).hexdigest(), c) for b, c, _, on in boards if b == s and on)[1] for s in counts}
    assert asked[asked.state == "half_open"].company_slug.tolist() == [first["custom"]]
    assert health.plan_cycle(companies, runs, now, "b").toPandas().lot.tolist() != asked.lot.tolist()
    assert health.plan_cycle(companies, runs, now, "a", force=True).filter("source = 'wttj'").count() == 1
    order = sorted((c for b, c, _, on in boards if b == "lever" and on), key=lambda c: hashlib.md5(f"a:lever:{c}".encode()).hexdigest())
    status = lambda s, c: "blocked" if c in (order[3], "workday4") else "error" if s == "personio" else "ok" if c != "workable0" else "empty"
    answers = spark.createDataFrame([(s, c, status(s, c), 2 if status(s, c) == "ok" else 0, 1, 0, 0, 0) for s, c, *_ in boards], "source string, company_slug string, status string, fetched int, new int, updated int, aliased int, rejected int")
    got = health.cycle_log(companies, runs, plan, answers, now).toPandas()
    assert set(got[(got.source == "lever") & got.company_slug.notna()].company_slug) == set(order[:4])
    whole = got[got.company_slug.isna()].set_index("source")
    assert whole.status.to_dict() == {"lever": "blocked", "ashby": "skipped", "workday": "ok", "custom": "ok", "personio": "error", "workable": "ok", "wttj": "skipped"}
    assert whole.error_kind.dropna().to_dict() == {"ashby": "breaker_open"} and whole.fetched.to_dict()["lever"] == 6 and whole.fetched.to_dict()["workday"] == 16
    empty = health.cycle_log(companies.limit(0), runs, health.plan_cycle(companies.limit(0), runs, now, "a"), answers, now)
    assert empty.count() == 0
