"""What evidence of pairs costs a row, and that it reads names as before."""

import datetime

from pyspark.sql import functions as F

from rowlens.functions.places import places
from rowlens.operators import resolve


def test_places_reads_a_text_once_a_row(spark):
    said = ["new york, london", "york", "paris/paris", "", None, "chicago  -  london uk", "londonderry"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", places(F.col("t")).alias("p"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    rows = {r.k: sorted(r.p.specific) for r in found.collect()}
    assert rows == {0: ["london", "new york"], 1: [], 2: ["paris"], 3: [], 4: [], 5: ["chicago", "london"], 6: []}


def test_the_name_speaks_for_a_row_without_a_title(spark):
    day = datetime.date(2001, 2, 3)
    rows = spark.createDataFrame([(f"r{k}", c, None, None, day, None, "") for k, c in enumerate(["Acme (Quant)", "Acme"])], "row_id string, company string, title string, location string, applied_on date, closed_on date, reason string")
    folders = spark.createDataFrame([("f1", "Acme", "Quant", day)], "folder_id string, company string, title string, day date")
    assert {(r.row_id, r.points) for r in resolve.candidate_pairs(rows, folders).collect()} == {("r0", 6), ("r1", 4)}


def test_pairs_to_assign_read_each_text_once(spark):
    rows, folders = (spark.createDataFrame([], s) for s in ("row_id string, company string, title string, location string, applied_on date, closed_on date, reason string", "folder_id string, company string, title string, day date"))
    pairs = resolve.candidate_pairs(rows.union(spark.createDataFrame([("r1", "Acme", "Quant", "Paris", None, None, "")], rows.schema)), folders.union(spark.createDataFrame([("f1", "acme", "Quant Paris", None)], folders.schema)))
    found = resolve.assign(pairs)
    assert [(r.row_id, r.folder_id, r.outcome) for r in found.collect()] == [("r1", "f1", "paired")]
    # a few for tokens and places of each side, not one for each of the 48 words for places
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 10


def test_links_read_each_text_once(spark):
    day = datetime.date(2001, 2, 3)
    posts = spark.createDataFrame([("p1", "acme", "Acme", "Quant", "Paris", day)], "posting_id string, company_slug string, company_name string, title string, places string, day date")
    apps = spark.createDataFrame([("a1", "Acme", None, "Quant", "Paris", day, "applied", "", None)], "application_id string, company string, company_slug string, title string, location string, applied_on date, status string, reason string, posting_id string")
    found = resolve.link_candidates(posts, apps)
    assert [(r.posting_id, r.application_id, r.points) for r in found.collect()] == [("p1", "a1", 5)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 10
