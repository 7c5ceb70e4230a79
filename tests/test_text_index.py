"""The index against the scan, over batches, and what a search opens."""

import itertools
import random

from rowlens.operators.search import Match, matching
from rowlens.operators.text_index import GramIndex, TextIndex

WORDS = ("rust", "Rústic", "engineer", "engine", "x", "of", "years")


def rows(seed, ids):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", " ".join(r.choices(WORDS, k=r.randint(1, 6))), ", ".join(r.choices(WORDS, k=4))])
    return [(i, text(), text(), text(), text()) for i in ids]


def test_index_equals_scan(spark, tmp_path):
    schema = "posting_id string, title string, company_name string, tech string, description string"
    first, second = rows(1, map(str, range(120))), rows(2, map(str, range(60, 160)))
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(first, schema))
    index.add(spark.createDataFrame(second, schema))
    now = {x[0]: x for x in first} | {x[0]: x for x in second}
    texts = spark.createDataFrame(list(now.values()), schema).cache()
    small = index.compact(f"file://{tmp_path}/compact")
    cases = [
        Match(every=("rust", "of")), Match(phrases=("of rust", "years")), Match(prefixes=("engin",)), Match(prefixes=("of engin",), none=("rustic",)), Match(any=("rust years", "x x")),
        Match(every=("RUSTIC",), columns=("title", "tech")), Match(none=("x",)), Match(every=("...",)), Match(any=("...", "x")), Match(every=("nothing",)), Match(phrases=("x x",), any=("of", "rust")),
    ]
    for match in cases:
        want = sorted(r.posting_id for r in matching(texts, match).collect())
        for i in (index, small):
            assert sorted(r.posting_id for r in i.matching(match).collect()) == want, match
    assert sorted(len(matching(texts, m).collect()) for m in cases)[-1] > 20


def test_a_search_opens_its_buckets_only(spark, tmp_path):
    schema = "posting_id string, title string, company_name string, tech string, description string"
    names = ["".join(x) for x in itertools.product("abcdef", repeat=3)]
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([(str(k), n, None, None, n * 2) for k, n in enumerate(names)], schema))
    plan = index.matching(Match(every=("abc",)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#").replace("[[", "[") and "EqualTo(word,abc)" in plan and "ArrowEvalPython" not in plan


def test_a_frequent_words_lists_stay_in_blocks(spark, tmp_path):
    """Rows of the index are one a word and block, not one a word and posting, and blocks are numbered once."""
    from pyspark.sql import functions as F

    schema = "posting_id string, title string, company_name string, tech string, description string"
    texts = spark.range(0, 3000, 1, 3).select(F.col("id").cast("string").alias("posting_id"), F.lit("same words, same").alias("title"), F.lit(None).cast("string").alias("company_name"), F.lit("").alias("tech"), F.concat(F.lit("word"), F.col("id")).alias("description"))
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(texts.select(*[x.split(" ")[0] for x in schema.split(", ")]))
    stored = spark.read.parquet(f"file://{tmp_path}/index/words")
    assert stored.filter("word = 'same'").count() == stored.filter("ids is not null").count() < 10
    assert stored.filter("word = 'same'").agg(F.sum(F.size("rows"))).first()[0] == 6000
    assert index.matching(Match(phrases=("words same",))).distinct().count() == 3000
    assert [r.posting_id for r in index.matching(Match(every=("word77", "same"))).collect()] == ["77"]


def test_substrings(spark, tmp_path):
    lines = {str(k): t for k, t in enumerate(["Ünïted", "united", "uni ted", "ab", "a", "", None, "aaaaab", "ba ab", "x\u0001y"])}
    index = GramIndex(spark, f"file://{tmp_path}/grams", ("line",))
    index.add(spark.createDataFrame(list(lines.items()), "posting_id string, line string"))
    for needle in ("unit", "i t", "ab", "b", "aab", "aaa", "United", "", "zz", "aaaaaab"):
        want = {k for k, t in lines.items() if needle.lower() in (t or "").lower().replace("ü", "u").replace("ï", "i")}
        assert {r.posting_id for r in index.containing(needle).collect()} == want, needle


def test_countries_in_order(spark):
    from pyspark.sql import functions as F

    from rowlens.functions.places import application_countries, countries_in

    cases = [("Paris, then Zürich", "FR,CH"), ("Germany or the UK, united kingdom", "DE,GB"), ("us and uk", ""), ("US", "US"), ("Londonderry", ""), ("London", ""), ("united states of america", "US"), (None, ""), ("Ireland (Paris)", "IE")]
    rows = spark.createDataFrame(cases, "t string, want string")
    for r in rows.select("t", "want", F.array_join(countries_in(F.col("t")), ",").alias("got")).collect():
        assert r.got == r.want, r.t
    one = spark.createDataFrame([("nowhere", "Quant Dev FRA"), ("Paris", "Dev US"), (None, "Paris")], "l string, t string")
    assert [r.v for r in one.select(application_countries(F.col("l"), F.col("t")).alias("v")).collect()] == [["FR"], ["FR"], []]
