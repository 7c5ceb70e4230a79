"""Duplicates of one board, canonical rows and their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.operators.store import Store
from rowlens.session import cut_lineage

GROUP = ["fingerprint", "source", "company_slug", "content_hash"]


def duplicate_members(store: Store) -> DataFrame:
    """Live canonical rows of one board with the same fingerprint and content: group, posting_id, place (1 is kept) and whether the group may merge.

    A location of the form "3 Locations" names no place: such rows make no group.
    Rows that only the user marked come first, then score, last sighting and id.
    A group with two marked rows is left alone.
    """
    rows = store.postings.filter(F.col("is_canonical") & F.col("is_active"))
    flagged = store.flags.select("posting_id").distinct().withColumn("__flag", F.lit(True))
    rows = rows.join(flagged, "posting_id", "left").withColumn("flagged", F.col("__flag").isNotNull())
    group = Window.partitionBy(*GROUP)
    named = ~F.coalesce("location_raw", F.lit("")).rlike("^[0-9].* Location")
    best = group.orderBy(F.desc("flagged"), F.desc("score"), F.desc("last_seen_at"), F.desc("posting_id"))
    found = rows.withColumn("members", F.sum(named.cast("int")).over(group)).filter("members > 1")
    return found.select(
        *GROUP, "posting_id", F.row_number().over(best).alias("place"), (F.sum(F.col("flagged").cast("int")).over(group) <= 1).alias("merges")
    )


def demotions(members: DataFrame) -> DataFrame:
    """old_id and new_id of the rows to drop."""
    keep = members.filter("merges and place = 1").select(*GROUP, F.col("posting_id").alias("new_id"))
    return members.filter("merges and place > 1").join(keep, GROUP).select(F.col("posting_id").alias("old_id"), "new_id")


def canonical_by_fingerprint(postings: DataFrame) -> DataFrame:
    """The row that stands for every fingerprint: active first, then last sighting, then the smallest id."""
    order = Window.partitionBy("fingerprint").orderBy(F.desc("is_active"), F.desc("last_seen_at"), "posting_id")
    return postings.filter("is_canonical").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def settle_chains(moves: DataFrame, rounds: int = 64) -> DataFrame:
    """old_id and new_id with every chain of moves followed to its end.

    Each round doubles the steps taken; most moves form no chain, and then none is
    needed. Moves in a circle have no end and are an error.
    """
    now = cut_lineage(moves.select("old_id", "new_id"))
    for _ in range(rounds):
        nxt = now.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"))
        if now.join(nxt, "new_id", "left_semi").isEmpty():
            return now
        now = cut_lineage(now.join(nxt, "new_id", "left").select("old_id", F.coalesce("further", "new_id").alias("new_id")))
    raise ValueError("moves form a circle")


def demote(store: Store, aliases: DataFrame, applications: DataFrame, moves: DataFrame) -> tuple[Store, DataFrame, DataFrame]:
    """Moves (old_id, new_id) applied: the old row is no longer canonical and becomes an alias; aliases, applications and marks follow, unless the new row has marks of its own."""
    to = settle_chains(moves)

    def moved(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(to, df[column] == to["old_id"], "left")
        return joined.select(*[F.coalesce("new_id", df[column]).alias(column) if c == column else df[c] for c in df.columns])

    postings = store.postings.join(to, store.postings["posting_id"] == to["old_id"], "left")
    postings = postings.select(*[(F.col(c) & F.col("old_id").isNull()).alias(c) if c == "is_canonical" else store.postings[c] for c in store.postings.columns])
    made = store.postings.join(to, store.postings["posting_id"] == to["old_id"]).select(
        F.col("new_id").alias("canonical_id"), "source", "source_job_id", "url", F.col("last_seen_at").alias("seen_at")
    )
    own = store.flags.select(F.col("posting_id").alias("own_id"))
    flags = store.flags.join(to, store.flags["posting_id"] == to["old_id"], "left")
    taken = flags.join(own, F.col("new_id") == F.col("own_id"), "left")
    taken = taken.filter("old_id is null or own_id is null")
    order = Window.partitionBy("posting_id").orderBy(F.col("__old").asc_nulls_first())
    taken = taken.select(*[F.coalesce("new_id", store.flags["posting_id"]).alias("posting_id") if c == "posting_id" else store.flags[c] for c in store.flags.columns], F.col("old_id").alias("__old"))
    marks = taken.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__old")
    return store.with_(postings=postings, flags=marks), record_aliases(moved(aliases, "canonical_id"), made), moved(applications, "posting_id")


def record_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """One alias per (source, source_job_id): the one seen last, new ones before old."""
    columns = ["canonical_id", "source", "source_job_id", "url", "seen_at"]
    both = aliases.select(*columns, F.lit(0).alias("__new")).unionByName(new.select(*columns, F.lit(1).alias("__new")))
    order = Window.partitionBy("source", "source_job_id").orderBy(F.desc("__new"), F.desc("seen_at"), "canonical_id")
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*columns)
