"""Applying a batch of normalized, scored postings to the stored ones.

Rows of one fingerprint affect each other in order, so the state machine runs per
fingerprint (and per identity already stored) as a grouped function over ids and
a few flags; the wide rows are joined afterwards, and stored rows of fingerprints
that the batch does not name are not touched. A group is one job's
republications, bounded by the sources that list it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.schemas import AGGREGATORS

IDENTITY = ["source", "company_slug", "source_job_id"]
STATE = "posting_id string, is_canonical boolean, is_active boolean, from_batch boolean, touched boolean, alias_of string"


def _best(rows: dict[str, dict], me: dict, leave_out: str | None = None) -> dict | None:
    """The canonical row that a posting repeats, if any."""
    found = sorted((r for r in rows.values() if r["is_canonical"] and r["posting_id"] != leave_out), key=lambda r: (not r["is_active"], -r["seen"], r["posting_id"]))
    if not found or me["source"] in AGGREGATORS:
        return found[0] if found else None
    board = [r for r in found if (r["source"], r["company_slug"]) == (me["source"], me["company_slug"])]
    twin = next((r for r in board if r["content_hash"] == me["content_hash"]), None)
    return twin or (None if any(r["is_active"] for r in board) else found[0])


def _takes_over(old: dict, source: str) -> bool:
    return source not in AGGREGATORS and (old["source"] in AGGREGATORS or not old["is_active"])


def step(rows: dict[str, dict], new: dict) -> None:
    """One record of a batch applied to the rows of its job, by id; a row that becomes an alias says of which."""
    old = rows.get(new["posting_id"])
    if old is not None and old["alias_of"] is None:
        changed = old["content_hash"] != new["content_hash"]
        old.update(seen=new["seen"], is_active=True, touched=True, from_batch=old["from_batch"] or changed, content_hash=new["content_hash"])
        if not old["is_canonical"]:
            best = _best(rows, new, new["posting_id"])
            if best is None or _takes_over(best, new["source"]):
                old["is_canonical"] = True
                if best is not None:
                    best.update(is_canonical=False, alias_of=new["posting_id"])
        elif changed:
            twin = _best(rows, new, new["posting_id"])
            if twin is not None and twin["content_hash"] == new["content_hash"] and twin["is_active"] and twin["source"] == new["source"]:
                old.update(is_canonical=False, alias_of=twin["posting_id"])
        return
    best = _best(rows, new)
    entry = new | {"from_batch": True, "touched": True, "is_active": True, "is_canonical": True, "alias_of": None}
    if best is not None and not _takes_over(best, new["source"]):
        entry.update(is_canonical=False, alias_of=best["posting_id"])
    elif best is not None:
        best.update(is_canonical=False, alias_of=new["posting_id"])
    rows[new["posting_id"]] = entry


def fold_group(group: pd.DataFrame) -> pd.DataFrame:
    """Stored rows and batch rows of one fingerprint, the batch in order, to the rows' new state."""
    rows: dict[str, dict] = {}
    for r in group[~group.in_batch].to_dict("records"):
        rows[r["posting_id"]] = r | {"from_batch": False, "touched": False, "alias_of": None}
    for new in group[group.in_batch].sort_values(["seen", "source", "source_job_id"]).to_dict("records"):
        step(rows, new)
    return pd.DataFrame(list(rows.values()))[[c.split(" ")[0] for c in STATE.split(", ")]]


def apply_batch(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, moves): postings after the batch, and (old_id, new_id, is_new) of rows that became aliases.

    Same content only touches last_seen_at and reopens; changed content rewrites the
    row but for first_seen_at; a new posting that repeats another becomes its alias,
    or takes its place if that one came from an aggregator or is closed.
    """
    narrow = ["posting_id", "fingerprint", *IDENTITY, "content_hash"]
    # of repeated records in one batch the last seen one counts
    once = batch.groupBy("posting_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "posting_id"]), F.struct("last_seen_at", "content_hash")).alias("r")).select("posting_id", "r.*")
    # a record that is stored under another fingerprint stays in that group
    known = stored.select("posting_id", F.col("fingerprint").alias("__old"))
    new = once.join(known, "posting_id", "left").select("posting_id", F.coalesce("__old", "fingerprint").alias("fingerprint"), *IDENTITY, "content_hash", F.lit(False).alias("is_canonical"), F.lit(True).alias("is_active"), F.unix_timestamp("last_seen_at").alias("seen"), F.lit(True).alias("in_batch"))
    # only jobs that the batch names can change: the rest of the store passes by
    named = new.select("fingerprint").distinct()
    rest, stored = stored.join(named, "fingerprint", "left_anti"), stored.join(named, "fingerprint", "left_semi").select(*stored.columns)
    old = stored.select(*narrow, "is_canonical", "is_active", F.unix_timestamp("last_seen_at").alias("seen"), F.lit(False).alias("in_batch"))
    state = old.unionByName(new).groupBy("fingerprint").applyInPandas(fold_group, STATE)
    moves = state.filter("alias_of is not null").select(F.col("alias_of").alias("new_id"), F.col("posting_id").alias("old_id"))
    stored_ids = stored.select(F.col("posting_id").alias("old_id"), F.lit(False).alias("__n"))
    moves = moves.join(stored_ids, "old_id", "left").select("old_id", "new_id", F.coalesce("__n", F.lit(True)).alias("is_new"))
    columns = stored.columns
    fresh = once.select("posting_id", F.struct(*[F.col(c) for c in columns if c in once.columns and c != "posting_id"]).alias("b"))
    have = stored.select("posting_id", F.struct(*[c for c in columns if c != "posting_id"]).alias("s"))
    wide = state.join(have, "posting_id", "left").join(fresh, "posting_id", "left")
    # a new posting that is only an alias has no row
    wide = wide.filter(~(F.col("s").isNull() & F.col("alias_of").isNotNull()))

    def value(c: str) -> F.Column:
        if c in ("is_canonical", "is_active"):
            return F.col(c)
        b = F.col(f"b.{c}") if c in once.columns else F.lit(None).cast(stored.schema[c].dataType)
        if c == "first_seen_at":
            return F.coalesce(f"s.{c}", b)
        if c == "last_seen_at":
            return F.when(F.col("touched"), F.coalesce(b, F.col(f"s.{c}"))).otherwise(F.col(f"s.{c}"))
        return F.when(F.col("from_batch"), b).otherwise(F.col(f"s.{c}"))

    postings = wide.select("posting_id", *[value(c).alias(c) for c in columns if c != "posting_id"]).select(*columns)
    return rest.select(*columns).unionByName(postings), moves


def deactivate_missing(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings of the boards in ``seen`` (source, company_slug, source_job_id) that it lacks are closed; a board with nothing seen closes nothing."""
    boards = seen.select("source", "company_slug").distinct().withColumn("__board", F.lit(True))
    ids = seen.select(*IDENTITY).distinct().withColumn("__seen", F.lit(True))
    rows = postings.join(boards, ["source", "company_slug"], "left").join(ids, IDENTITY, "left")
    gone = F.coalesce("__board", F.lit(False)) & F.col("__seen").isNull()
    return rows.select(*[(F.col(c) & ~gone).alias(c) if c == "is_active" else c for c in postings.columns])


def close_silent(postings: DataFrame, as_of: Column | str, silence_s: int) -> DataFrame:
    """Postings that no batch has named for so many seconds are closed."""
    until = F.unix_timestamp(F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of)
    heard = F.unix_timestamp("last_seen_at") + silence_s > until
    return postings.select(*[(F.col(c) & heard).alias(c) if c == "is_active" else c for c in postings.columns])


def update_resolution(postings: DataFrame, resolved: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Resolved fields rewritten; dedup and activity stay, a closed posting is not reopened."""
    new = resolved.select("posting_id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    rows = postings.join(new, "posting_id", "left")
    return rows.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in postings.columns])


def merge_marks(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """The user's marks with changes (null: unchanged), column by column."""
    fields = [c for c in flags.columns if c != "posting_id"]
    new = changes.select("posting_id", *[F.col(c).alias(f"__{c}") for c in fields if c in changes.columns])
    rows = flags.join(new, "posting_id", "full")
    return rows.select("posting_id", *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in rows.columns else F.col(c) for c in fields])


def sync_companies(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows replace registered ones and keep their health columns; discovered rows stay until the registry names them."""
    health = [c for c in ("last_ok_at", "last_count") if c in stored.columns]
    kept = stored.select("company_slug", *health)
    named = registry.join(kept, "company_slug", "left").withColumn("discovered", F.lit(False))
    found = stored.filter("discovered").join(registry.select("company_slug"), "company_slug", "left_anti")
    return named.select(*stored.columns).unionByName(found.select(*stored.columns))


def ensure_discovered(companies: DataFrame, employers: DataFrame) -> DataFrame:
    """Companies plus the employers (company_slug, company_name, source) they lack, as discovered ones."""
    new = employers.dropDuplicates(["company_slug"]).join(companies.select("company_slug"), "company_slug", "left_anti")
    return companies.unionByName(new.withColumn("discovered", F.lit(True)).withColumn("enabled", F.lit(False)), allowMissingColumns=True)


def keep_newest(old: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Keyed upsert: the newest row of every key."""
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in old.columns if c not in keys]), by).alias("r")).select(*keys, "r.*").select(*old.columns)
