"""What of a reader's claims is taken: pay, level, doctorate, date and years over raw texts, and taking them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.config import build_profile
from rowlens.operators import review
from rowlens.plans.projection import canonical
from rowlens.plans.registry import query

#: Of every posting one kind of claim by the key's remainder, with a quote that only some texts have.
_JUDGED = """, r as (select p.*, d.title_raw, d.description_raw as d, cast(p.posting_id as bigint) as k, cast(1 + cast(p.posting_id as bigint) % 8 as varchar) as n
        from postings p join raw d on d.source_job_id = 'j' || cast(cast(p.posting_id as bigint) as varchar)),
    c as (select *, k % 5 as kind, 5 + (k // 5) % 5 >= 6 as heard, 5 + (k // 5) % 5 >= 8 as sure from r),
    j as (select *, case kind when 0 then 'compensation' when 1 then 'seniority' when 2 then 'phd_required' when 3 then 'closes_at' else 'min_years' end as field,
        case kind when 0 then true when 1 then seniority <> 'senior' when 2 then not phd_required when 3 then closes_at is null else min_years is null or min_years <> cast(n as int) end as changes,
        case kind when 0 then case when not contains(d, 'Salary: $1' || n || '0,000 - $2' || n || '0,000 per year') then 'quote_not_found' end
            when 1 then case when not contains(lower(title_raw), 'senior') then 'level_not_quoted' when seniority <> 'unknown' and not sure then 'confidence_below_override' end
            when 2 then case when not contains(d, 'A PhD is required') then 'doctorate_not_quoted' when not sure then 'confidence_below_override' end
            when 3 then case when not contains(d, 'Bring your ideas') then 'quote_not_found' else 'date_not_quoted' end
            else case when not contains(d, 'We need ' || n || '+ years of C++') then 'quote_not_found' when min_years is not null and not sure then 'confidence_below_override' end end as why from c),
    t as (select *, heard and changes and why is null as taken from j)"""


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    rows = canonical(spark, sf, "postings").withColumn("k", F.col("posting_id").cast("long")).withColumn("source_job_id", F.concat(F.lit("j"), F.col("k").cast("string")))
    raw = canonical(spark, sf, "raw").select("source_job_id", "title_raw", F.col("description_raw").alias("description"))
    rows = rows.join(raw, "source_job_id").withColumn("n", (1 + k % 8).cast("string"))
    none = F.lit(None).cast("string")
    pay = F.struct(none.cast("decimal(18,4)").alias("amount_min"), none.cast("decimal(18,4)").alias("amount_max"), none.alias("currency"), none.alias("period"))
    kind = k % 5
    claims = {
        "amount_min": F.when(kind == 0, F.concat(F.lit("1"), n, F.lit("0000"))), "amount_max": F.when(kind == 0, F.concat(F.lit("2"), n, F.lit("0000"))), "currency": F.when(kind == 0, "usd"), "period": F.when(kind == 0, "year"),
        "pay_quote": F.when(kind == 0, F.concat(F.lit("Text: Salary: $1"), n, F.lit("0,000 - $2"), n, F.lit("0,000 per year"))), "seniority": F.when(kind == 1, "senior"),
        "level_quote": F.when(kind == 1, F.col("title_raw")).when(kind == 4, F.concat(F.lit("We need "), n, F.lit("+ years of C++"))), "phd_quote": F.when(kind == 2, "A PhD is required"),
        "closes_on": F.when(kind == 3, "2001-12-23"), "closes_quote": F.when(kind == 3, "Bring your ideas"), "visa": none, "visa_quote": none,
    }
    replies = rows.select("posting_id", F.round(0.5 + F.floor(k / 5) % 5 / 10, 1).alias("confidence"), *[c.alias(name) for name, c in claims.items()], F.when(kind == 4, n.cast("int")).alias("min_years"), (kind == 2).alias("phd"))
    return review.plan(rows.withColumn("compensation", pay), replies, build_profile())


@query(
    _JUDGED + """ select posting_id, case when not heard then 'set_aside' when taken then 'corrected' else 'confirmed' end as outcome, case when taken then field else '' end as fields,
    case when heard and changes and why is not null then field || ': ' || why else '' end as refused from t""",
    "postings", "raw",
)
def reviewed_claims(spark, sf):
    """Which claims of pay, level, doctorate, date and years are taken, and why the others are not."""
    found = _reviewed(spark, sf)
    return found.select("posting_id", "outcome", F.array_join(F.transform("corrections", lambda c: c["field"]), ",").alias("fields"), F.array_join("refused", ",").alias("refused"))


@query(_JUDGED + " select posting_id, field, case kind when 1 then seniority when 2 then 'false' when 4 then cast(min_years as varchar) end as before from t where taken and kind in (1, 2, 4)", "postings", "raw")
def reverted_claims(spark, sf):
    """What taking back all corrections of level, doctorate and years restores."""
    taken = _reviewed(spark, sf).select("posting_id", F.explode("corrections").alias("c")).select("posting_id", "c.*").withColumn("correction_id", F.monotonically_increasing_id())
    restored, _ = review.revert(taken, ("seniority", "phd_required", "min_years"))
    return restored
