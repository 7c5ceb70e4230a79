"""Exact deduplication by skew-safe combining.

Copies are combined three times, and every time the full content is part of the
grouping key, never the digest alone:

1. inside each map task (the map side of a hash aggregation),
2. in salted digest groups, where the salt is the map task's number modulo
   ``salts``: a text that fills a third of all rows reaches each salted group
   as one row per task, spread over ``salts`` reducers,
3. over the salt winners, at most ``salts`` rows per text.

The mapping from digest to the row that stays is a narrow table. Stage 3 has
seen every content behind a digest, so where it found exactly one, documents
take their group by digest alone and no text is shuffled again; the digests with
several contents (none for SHA-256 in practice) are joined with their text. Digests of
more than one row in ``HOT`` are fewer than ``HOT`` whatever the table holds; they
are broadcast, and the others are joined by digest, so no key of that join is hot.

Defined results: null text counts as empty, and all empty texts are copies of
each other. A null id is never the largest while another id exists; a group of
null ids only keeps null. Rows that repeat id and text count in ``group_size``
and share ``kept``. An empty table gives an empty result. Columns other than id
and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import stage_table, text_or_empty, unused

SALTS = 64
#: A text of more than one in so many rows is hot; so many hot texts at most can be.
HOT = 2_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    mapping = stage_table(
        winners.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents")
        ),
        "exact-mapping",
    )
    one = mapping.filter("contents = 1").select("digest", "keep_id", "group_size")
    total = mapping.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT > total
    often = F.broadcast(one.filter(hot).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    marked = rows.select("doc_id", "digest").join(often, "digest", "left")
    # a hot row's key is its own, so that they spread and meet nothing
    own = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0")))
    rare = one.filter(~hot).withColumnRenamed("digest", "key")
    found = marked.withColumn("key", own).join(rare, "key", "left").filter("hot_size is not null or group_size is not null")
    found = found.select("doc_id", "digest", F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))
    if mapping.filter("contents > 1").limit(1).count():
        several = rows.join(mapping.filter("contents > 1").select("digest"), "digest", "left_semi")
        groups = several.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        found = found.unionByName(
            several.join(groups, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return found.select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_exact(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per text, all columns as they are: the one with the largest doc_id.

    Whole rows are dealt once, by id and digest, which no two kept rows share. Of rows
    that repeat id and text one stays; only those, if there are any, are counted off.
    """
    mine, other, own, place = (unused(name, docs) for name in ("__id", "__digest", "__own", "__place"))
    groups = exact_groups(docs).filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = stage_table(groups.select(F.col("doc_id").alias(mine), F.col("digest").alias(other), (F.col("n") > 1).alias("again")), "exact-kept")
    rows = docs.withColumn(own, sha256(text_or_empty("text")))
    same = lambda right: rows.join(right, F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(own) == F.col(other)), "left_semi")
    if kept.filter("again").isEmpty():
        return same(kept).drop(own)
    number = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.lit(0)))
    counted = same(kept.filter("again")).withColumn(place, number).filter(F.col(place) == 1).drop(place)
    return same(kept.filter("not again")).unionByName(counted).drop(own)


def exact_result(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
select doc_id,
       max(doc_id) over w as keep_id,
       count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
"""
