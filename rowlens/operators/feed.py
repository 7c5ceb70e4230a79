"""The feed: filters, effective verdicts, sorts and keyset pages.

A filter becomes predicates on the joined base and semi joins on the child
frames; each list of values stays an ``isin`` that reaches the scan. Sorting with
a limit is one top-k per partition and a merge; pages continue after a key, never
by skipping rows.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions import dates
from rowlens.operators import search
from rowlens.operators.store import Store


@dataclass(frozen=True)
class PostingFilter:
    """All conditions hold together; an empty tuple is no condition."""

    countries: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    #: (country, city) of one and the same location row.
    place: tuple[str, str] | None = None
    remote_modes: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    role_families: tuple[str, ...] = ()
    seniorities: tuple[str, ...] = ()
    visa: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    rejection_reasons: tuple[str, ...] = ()
    tech_any: tuple[str, ...] = ()
    tech_all: tuple[str, ...] = ()
    min_score: int = 0
    posted_within_days: int | None = None
    query: search.Match | None = None
    statuses: tuple[str, ...] = ()
    favorites_only: bool = False
    include_hidden: bool = False
    #: None: postings not triaged yet; a value: that verdict's own list.
    triage: str | None = None
    #: None: the main feed; a value: postings with a verdict of that track.
    track: str | None = None

    def without(self, field: str) -> PostingFilter:
        return replace(self, **{field: ()})


#: What a caller gets that states no filter.
DEFAULT_FILTER = PostingFilter(visa=("sponsors", "unknown"), tiers=("strong", "possible", "stretch"))
#: The user's lists as filters.
TABS = {
    "inbox": DEFAULT_FILTER,
    "maybe": PostingFilter(triage="maybe"),
    "no": PostingFilter(triage="no"),
    "applied": PostingFilter(statuses=("applied", "interview", "offer", "rejected", "withdrawn")),
    "filtered_out": PostingFilter(tiers=("rejected",)),
}
PAGE, MOST = 50, 100

#: Sort key: column and whether it descends; nulls come last, ties follow posting_id in the same direction.
SORTS = {
    "score": ("eff_score", True),
    "posted": ("posted_at", True),
    "seen": ("first_seen_at", True),
    "company": ("company_slug", False),
    "closes": ("closes_at", False),
}


class CursorError(ValueError):
    """A page mark that no page gave out."""


def joined(store: Store, flt: PostingFilter) -> DataFrame:
    """Postings with company, the user's marks and the verdict that the filter's feed reads."""
    companies = store.companies.select("company_slug", "company_name", "sector")
    flags = store.flags.select("posting_id", "is_favorite", "is_hidden", "triage", "application_status", "note")
    if flt.track is None:
        verdicts = store.verdicts.select("posting_id", "rejection_reason")
        base = store.postings.join(verdicts, "posting_id", "left").withColumn("eff_score", F.col("score")).withColumn("eff_tier", F.col("tier"))
    else:
        verdicts = store.track_verdicts.filter(F.col("track") == flt.track)
        verdicts = verdicts.select("posting_id", F.col("score").alias("eff_score"), F.col("tier").alias("eff_tier"), "rejection_reason")
        base = store.postings.join(verdicts, "posting_id")
    return base.join(companies, "company_slug").join(flags, "posting_id", "left")


def needs_active(flt: PostingFilter) -> bool:
    """Closed postings leave the feed, but not the lists of what the user marked."""
    return not flt.favorites_only and not flt.statuses and flt.triage is None


def predicates(flt: PostingFilter, as_of: datetime | str | None) -> list[Column]:
    """Conditions on the joined row."""
    found = [F.col("is_canonical")]
    if needs_active(flt):
        found.append(F.col("is_active"))
    for column, values in (
        ("company_slug", flt.companies), ("sector", flt.sectors), ("source", flt.sources), ("role_family", flt.role_families), ("seniority", flt.seniorities),
        ("visa_sponsorship", flt.visa), ("eff_tier", flt.tiers), ("rejection_reason", flt.rejection_reasons),
    ):
        if values:
            found.append(F.col(column).isin(*values))
    if flt.min_score:
        found.append(F.col("eff_score") >= flt.min_score)
    if flt.posted_within_days is not None:
        if as_of is None:
            raise ValueError("posted_within_days needs as_of")
        found.append(dates.within_days(dates.feed_date(F.col("posted_at"), F.col("first_seen_at")), flt.posted_within_days, as_of))
    if flt.statuses:
        found.append(F.col("application_status").isin(*flt.statuses))
    elif flt.triage is None and not flt.favorites_only:
        found.append(F.col("application_status").isNull())
    if flt.favorites_only:
        found.append(F.col("is_favorite"))
    if not flt.include_hidden:
        found.append(~F.coalesce("is_hidden", F.lit(False)))
    found.append(F.col("triage").isNull() if flt.triage is None else F.col("triage") == flt.triage)
    return found


def has_all_tags(tech: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """posting_id of postings with every one of the tags (relational division)."""
    wanted = tech.filter(F.col("tech").isin(*tags))
    return wanted.groupBy("posting_id").agg(F.count_distinct("tech").alias("n")).filter(F.col("n") == len(set(tags))).select("posting_id")


def child_conditions(store: Store, flt: PostingFilter) -> list[DataFrame]:
    """posting_id frames that a posting must be in."""
    places = store.locations
    found = []
    if flt.countries:
        found.append(places.filter(F.col("country").isin(*flt.countries)))
    if flt.cities:
        found.append(places.filter(F.col("city").isin(*flt.cities)))
    if flt.place:
        found.append(places.filter((F.col("country") == flt.place[0]) & (F.col("city") == flt.place[1])))
    if flt.remote_modes:
        found.append(places.filter(F.col("remote_mode").isin(*flt.remote_modes)))
    if flt.tech_any:
        found.append(store.tech.filter(F.col("tech").isin(*flt.tech_any)))
    if flt.tech_all:
        found.append(has_all_tags(store.tech, flt.tech_all))
    if flt.query is not None:
        found.append(search.matching(store.texts, flt.query))
    return [f.select("posting_id") for f in found]


def base_feed(store: Store, flt: PostingFilter = DEFAULT_FILTER, as_of: datetime | str | None = None) -> DataFrame:
    """Every row that the filter admits; shared by feed, facets, map and export."""
    rows = joined(store, flt)
    for p in predicates(flt, as_of):
        rows = rows.filter(p)
    for ids in child_conditions(store, flt):
        rows = rows.join(ids, "posting_id", "left_semi")
    return rows.select(
        *[c for c in rows.columns if c not in ("is_favorite", "is_hidden", "note")],
        F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        F.coalesce("is_hidden", F.lit(False)).alias("is_hidden"),
        F.coalesce("note", F.lit("")).alias("note"),
    )


def order(sort: str) -> list[Column]:
    column, down = SORTS[sort]
    key = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last()
    return [key, F.col("posting_id").desc() if down else F.col("posting_id").asc()]


def encode_cursor(value: object, posting_id: str) -> str:
    kind = "t" if isinstance(value, datetime) else "v"
    plain = value.isoformat() if isinstance(value, datetime) else value
    return base64.urlsafe_b64encode(json.dumps([kind, plain, posting_id]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[object, str]:
    try:
        kind, value, posting_id = json.loads(base64.urlsafe_b64decode(cursor.encode("ascii")))
        if not isinstance(posting_id, str) or kind not in ("t", "v"):
            raise ValueError(cursor)
        return (datetime.fromisoformat(value) if kind == "t" else value), posting_id
    except (ValueError, TypeError, UnicodeError) as e:
        raise CursorError(f"invalid cursor {cursor!r}") from e


def after(sort: str, value: object, posting_id: str) -> Column:
    """Rows strictly behind a key, nulls last."""
    column, down = SORTS[sort]
    c, i = F.col(column), F.col("posting_id")
    behind_id = i < posting_id if down else i > posting_id
    if value is None:
        return c.isNull() & behind_id
    behind = c < F.lit(value) if down else c > F.lit(value)
    return c.isNull() | behind | ((c == F.lit(value)) & behind_id)


def feed(
    store: Store, flt: PostingFilter = DEFAULT_FILTER, sort: str = "score", cursor: str | None = None, limit: int = PAGE, as_of: datetime | str | None = None
) -> DataFrame:
    """One page of the feed, ordered, of at most ``MOST`` rows; a limit of 0 gives none."""
    rows = base_feed(store, flt, as_of)
    if cursor is not None:
        rows = rows.filter(after(sort, *decode_cursor(cursor)))
    return rows.orderBy(*order(sort)).limit(min(limit, MOST))


def page(store: Store, flt: PostingFilter = DEFAULT_FILTER, sort: str = "score", cursor: str | None = None, limit: int = PAGE, as_of: datetime | str | None = None):
    """Rows of a page and the mark of the next one, None on the last; at most ``MOST`` rows reach the driver."""
    rows = base_feed(store, flt, as_of)
    if cursor is not None:
        rows = rows.filter(after(sort, *decode_cursor(cursor)))
    limit = min(limit, MOST)
    found = rows.orderBy(*order(sort)).limit(limit + 1).collect()
    last = found[limit - 1] if len(found) > limit else None
    return found[:limit], last and encode_cursor(last[SORTS[sort][0]], last["posting_id"])


def newer_than(rows: DataFrame, previous_visit: datetime | str) -> DataFrame:
    return rows.filter(F.col("first_seen_at") > F.lit(previous_visit).cast("timestamp"))


def company_list(companies: DataFrame, sector: str | None = None, hq_country: str | None = None, include_discovered: bool = False) -> DataFrame:
    """Registry companies in slug order."""
    rows = companies
    if sector is not None:
        rows = rows.filter(F.col("sector") == sector)
    if hq_country is not None:
        rows = rows.filter(F.col("hq_country") == hq_country)
    return (rows if include_discovered else rows.filter(~F.col("discovered"))).orderBy("company_slug")


def detail(store: Store, posting_id: str, aliases: DataFrame, corrections: DataFrame, track: str | None = None) -> DataFrame:
    """One posting with effective verdict (the track's, else the main one), aliases newest first, current corrections and description."""
    one = store.postings.filter(F.col("posting_id") == posting_id)
    main = store.verdicts.select("posting_id", F.col("score").alias("v_score"), F.col("tier").alias("v_tier"), F.col("rejection_reason").alias("v_reason"))
    rows = one.join(main, "posting_id", "left")
    own = store.track_verdicts.filter(F.col("track") == F.lit(track)).select("posting_id", F.col("score").alias("t_score"), F.col("tier").alias("t_tier"), F.col("rejection_reason").alias("t_reason"), F.lit(True).alias("in_track"))
    rows = rows.join(own, "posting_id", "left")
    alias_list = aliases.filter(F.col("canonical_id") == posting_id).groupBy(F.col("canonical_id").alias("posting_id")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("seen_at", "source", "source_job_id", "url")))).alias("aliases")
    )
    current = corrections.join(store.postings.select("posting_id", "content_hash"), ["posting_id", "content_hash"]).filter(F.col("posting_id") == posting_id)
    fixed = current.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("correction_id", "field", "before", "after"))).alias("corrections"))
    rows = rows.join(alias_list, "posting_id", "left").join(fixed, "posting_id", "left")
    if store.texts is not None:
        rows = rows.join(store.texts.select("posting_id", "description"), "posting_id", "left")
    hit = F.col("in_track")
    return rows.select(
        *[c for c in one.columns if c not in ("score", "tier")],
        F.when(hit, F.col("t_score")).otherwise(F.coalesce("v_score", "score")).alias("score"),
        F.when(hit, F.col("t_tier")).otherwise(F.coalesce("v_tier", "tier")).alias("tier"),
        F.when(hit, F.col("t_reason")).otherwise(F.col("v_reason")).alias("rejection_reason"),
        "aliases", "corrections", *(["description"] if store.texts is not None else []),
    )


def id_by_url(postings: DataFrame, aliases: DataFrame, url: str) -> DataFrame:
    """posting_id of a URL: its own posting first, then one that has it as an alias."""
    own = postings.filter(F.col("url") == url).select("posting_id", F.lit(0).alias("place"))
    known = aliases.filter(F.col("url") == url).select(F.col("canonical_id").alias("posting_id"), F.lit(1).alias("place"))
    return own.unionByName(known).orderBy("place", "posting_id").limit(1).select("posting_id")
