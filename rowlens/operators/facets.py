"""Facet counts, map counts and option lists over the feed's base."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.config import Geo
from rowlens.functions.money import pin_radius
from rowlens.functions.places import with_coordinates
from rowlens.operators.feed import DEFAULT_FILTER, PostingFilter, base_feed
from rowlens.operators.store import Store

#: Dimension: the filter field it leaves out, its value column, and the child frame that holds it.
DIMENSIONS = {
    "countries": ("countries", "country", "locations"),
    "cities": ("cities", "city", "locations"),
    "companies": ("companies", "company_slug", None),
    "sectors": ("sectors", "sector", None),
    "sources": ("sources", "source", None),
    "seniorities": ("seniorities", "seniority", None),
    "tech": ("tech_any", "tech", "tech"),
    "rejection_reasons": ("rejection_reasons", "rejection_reason", None),
}


def facet(store: Store, dimension: str, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """dimension, value and n: postings per value under the filter without the dimension's own field."""
    field, column, child = DIMENSIONS[dimension]
    rows = base_feed(store, flt.without(field), as_of)
    if child:
        # one row per posting and value first: the count then needs no distinct
        values = getattr(store, child).select("posting_id", F.col(column).alias("value")).filter("value is not null").distinct()
        rows = rows.select("posting_id").join(values, "posting_id")
    else:
        rows = rows.select("posting_id", F.col(column).alias("value")).filter("value is not null")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(dimension).alias("dimension"), "value", "n")


def facet_counts(store: Store, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """All dimensions, one below the other, from one reading of the feed.

    The base is filtered by everything but the dimensions' own fields; each row says which
    of those fields it fails. A row counts in the dimensions that leave out what it fails:
    in all of them if that is nothing, in one if it is one, in none beyond that.
    """
    fields = {field: (column, child) for field, column, child in DIMENSIONS.values()}
    rows = base_feed(store, reduce(lambda f, name: f.without(name), fields, flt), as_of)
    own = {column for column, child in fields.values() if not child}
    fails = []
    for field, (column, child) in fields.items():
        values = getattr(flt, field)
        if values and child:
            mark = f"__{field}"
            holders = getattr(store, child).filter(F.col(column).isin(*values)).select("posting_id").distinct().withColumn(mark, F.lit(True))
            rows = rows.join(holders, "posting_id", "left")
            fails.append(F.when(F.col(mark).isNull(), F.lit(field)))
        elif values:
            fails.append(F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), F.lit(field)))
    failed = F.array_compact(F.array(*fails)) if fails else F.expr("cast(array() as array<string>)")
    rows = rows.select("posting_id", *sorted(own), failed.alias("failed")).filter("size(failed) < 2")

    def valued(frame: DataFrame, names: list[str]) -> DataFrame:
        """(dimension, value) of each row for the dimensions that it counts in."""
        pairs = [F.when((F.size("failed") == 0) | F.array_contains("failed", DIMENSIONS[d][0]), F.struct(F.lit(d).alias("dimension"), F.col(DIMENSIONS[d][1]).alias("value"))) for d in names]
        return frame.select("posting_id", F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("posting_id", "x.*").filter("value is not null")

    parts = [valued(rows, [d for d, (_, _, child) in DIMENSIONS.items() if not child])]
    for child in sorted({child for _, _, child in DIMENSIONS.values() if child}):
        names = [d for d, (_, _, c) in DIMENSIONS.items() if c == child]
        values = getattr(store, child).select("posting_id", *[DIMENSIONS[d][1] for d in names])
        # a posting counts once for a value: distinct first, the count then needs none
        parts.append(valued(rows.select("posting_id", "failed").join(values, "posting_id"), names).distinct())
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def options(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """value and n: the counted values and the selected ones (0 where not counted), largest first."""
    merged = counts.select("value", "n").join(selected.select("value").distinct(), "value", "full")
    return merged.select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy(F.desc("n"), "value")


def located(store: Store, flt: PostingFilter, as_of: datetime | str | None = None) -> DataFrame:
    """posting_id, country and city of the admitted postings' places that the filter also admits as places."""
    rows = store.locations.filter("city is not null")
    for column, values in (("country", flt.countries), ("city", flt.cities), ("remote_mode", flt.remote_modes)):
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    return base_feed(store, flt, as_of).select("posting_id").join(rows.select("posting_id", "country", "city").distinct(), "posting_id")


def location_counts(store: Store, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """country, city, n and the smallest posting_id, largest first."""
    found = located(store, flt, as_of).groupBy("country", "city").agg(F.count(F.lit(1)).alias("n"), F.min("posting_id").alias("sample"))
    return found.orderBy(F.desc("n"), "country", "city")


def map_totals(store: Store, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """One row: postings in all, with a place, without one."""
    base = base_feed(store, flt, as_of).select("posting_id")
    placed = located(store, flt, as_of).select("posting_id").distinct().withColumn("placed", F.lit(1))
    found = base.join(placed, "posting_id", "left").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("placed"), F.lit(0)).cast("long").alias("placed"))
    return found.withColumn("unplaced", F.col("total") - F.col("placed"))


def map_pins(store: Store, geo: Geo, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """Pins with coordinates; cities that the referential lacks have none, and a sample is named only where it is the only one."""
    pins = with_coordinates(location_counts(store, flt, as_of), geo).filter("lat is not null")
    return pins.select("country", "city", "lat", "lon", "n", F.when(F.col("n") == 1, F.col("sample")).alias("sample"), pin_radius(F.col("n")).alias("radius"))
