"""What queries deal out: inputs once, and repeats where their page lies."""

from pyspark.sql import functions as F

from rowlens.operators import replay
from rowlens.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_pages_of_all_sources_are_dealt_once(spark):
    found = catalog.source_records(spark, SMALL)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == len(catalog._CARRIED)
    found = found.groupBy("source").count()
    counts = {r["source"]: r["count"] for r in found.collect()}
    assert len(counts) == 10 and len(set(counts.values())) == 1
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_outdated_decides_in_one_join(spark):
    stored = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "x", 2), ("d", None, 2), ("e", None, 1), ("f", "x", None)], "posting_id string, content_hash string, normalize_version int")
    raw = spark.createDataFrame([(i, h, i * 2) for i, h in zip("abcdefg", "xxyxxyx")], "posting_id string, content_hash string, title_raw string")
    found = replay.outdated(stored, raw, 2)
    assert {r.posting_id for r in found.collect()} == {"a", "c", "e"} and found.columns == raw.columns
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_moves_equal_transitions_without_a_join(spark):
    rows = spark.createDataFrame([("1", "x", "y"), ("2", "x", "y"), ("3", None, "x"), ("4", "x", None), (None, "x", "y")], "posting_id string, before_role string, after_role string")
    side = lambda s: rows.select("posting_id", F.col(f"{s}_role").alias("role"))
    found = replay.moves(rows, "role")
    assert sorted(map(str, found.collect())) == sorted(map(str, replay.transitions(side("before"), side("after"), "role").collect()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
