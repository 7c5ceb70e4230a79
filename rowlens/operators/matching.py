"""Greedy one-to-one assignment as rounds of windows and joins.

The assignment takes pairs in order of points (most first), then ids, and a pair whose
sides are both free is taken, or its left side set aside as ambiguous where a tie leaves
the choice open. Which pair comes first matters only among pairs that share a side, so a
round decides at once every left row whose best pairs come first at all their right
rows; the earliest pair left is always among them. Rows that look alike (``twin``) have the same pairs,
so they are decided as one class, the first of them taking the first right row and so on.

A round groups pairs by left row, right row and class, ids and points only; a group holds
the pairs of one id, never those of a whole employer. Rounds are as many as the longest
chain of pairs that wait for each other, not as the pairs. Every round is behind a
reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.session import cut_lineage


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    for part in parts:
        empty = empty.unionByName(part)
    return empty


def _best(live: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs with the row's most points, whether each is its row's, and their place in the order of the right side."""
    row = Window.partitionBy(left)
    return live.withColumn("best", F.col("points") == F.max("points").over(row)).withColumn("place", F.row_number().over(row.orderBy(F.desc("points"), right)))


def one_to_one(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, folder_id) that are paired, and (row_id, candidates) of rows that stay ambiguous.

    pairs: row_id, folder_id, twin, points. Of a row's tied folders one is taken only if
    enough free twins of the row explain the tie; else the row is ambiguous.
    """
    live = cut_lineage(pairs.select("row_id", "folder_id", "twin", "points"))
    paired, tied = [], []
    of_class = Window.partitionBy("twin").orderBy("row_id")
    of_folder = Window.partitionBy("folder_id").orderBy(F.desc("points"))
    while not live.isEmpty():
        marked = _best(live, "row_id", "folder_id").withColumn("rank", F.dense_rank().over(of_class)).withColumn("later", F.dense_rank().over(Window.partitionBy("twin").orderBy(F.desc("row_id"))) - 1)
        upto = of_folder.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        marked = marked.withColumn("alone", (F.min("twin").over(upto) == F.col("twin")) & (F.max("twin").over(upto) == F.col("twin")))
        marked = marked.withColumn("first", F.row_number().over(Window.partitionBy("folder_id").orderBy(F.desc("points"), "row_id")) == 1)
        rows = marked.filter("best").groupBy("row_id").agg(
            F.min("alone").alias("alone"), F.min("first").alias("first"), F.min("rank").alias("rank"), F.min("later").alias("later"), F.sort_array(F.collect_list("folder_id")).alias("candidates")
        )
        n = F.size("candidates")
        enough = F.col("rank") + F.col("later") >= n
        found = (
            F.when(F.col("alone") & enough & (F.col("rank") <= n), F.struct(F.lit("paired").alias("what"), F.get("candidates", F.col("rank") - 1).alias("folder_id")))
            .when(F.col("alone") & ~enough, F.struct(F.lit("tied").alias("what"), F.lit(None).cast("string").alias("folder_id")))
            .when(~F.col("alone") & F.col("first") & (F.col("rank") == 1) & enough, F.struct(F.lit("paired").alias("what"), F.get("candidates", 0).alias("folder_id")))
            .when(~F.col("alone") & F.col("first") & (F.col("rank") == 1), F.struct(F.lit("tied").alias("what"), F.lit(None).cast("string").alias("folder_id")))
        )
        decided = cut_lineage(rows.withColumn("found", found).filter("found is not null").select("row_id", "found.what", "found.folder_id", "candidates"))
        paired.append(decided.filter("what = 'paired'").select("row_id", "folder_id"))
        tied.append(decided.filter("what = 'tied'").select("row_id", "candidates"))
        live = cut_lineage(live.join(decided.select("row_id"), "row_id", "left_anti").join(paired[-1].select("folder_id"), "folder_id", "left_anti"))
    none = pairs.filter(F.lit(False))
    return _union(paired, none.select("row_id", "folder_id")), _union(tied, none.select("row_id", F.array("folder_id").alias("candidates")))


def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posting_id, application_id) that are linked, and (posting_id, ambiguous) of postings whose tie is between different applications.

    pairs: posting_id, application_id, twin (of the application), points; applications that look alike are no tie.
    """
    live = cut_lineage(pairs.select("posting_id", "application_id", "twin", "points"))
    done, open_ = [], []
    while not live.isEmpty():
        marked = _best(live, "posting_id", "application_id")
        kinds = marked.filter("best").groupBy("posting_id").agg(F.count_distinct("twin").alias("kinds"))
        # postings in the order in which they come to a class of applications
        asks = marked.groupBy("twin", "posting_id").agg(F.max("points").alias("points"), F.max("best").alias("best")).join(kinds, "posting_id")
        order = Window.partitionBy("twin").orderBy(F.desc("points"), "posting_id")
        simple = F.col("best") & (F.col("kinds") == 1)
        asks = asks.withColumn("rank", F.row_number().over(order)).withColumn("waits", F.sum((~simple).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        offers = marked.select("twin", "application_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("twin").orderBy("application_id")))
        taken = cut_lineage(asks.filter("waits = 0").join(offers, ["twin", "rank"]).select("posting_id", "application_id"))
        first = asks.filter("best and kinds > 1").groupBy("posting_id").agg(F.max("rank").alias("rank")).filter("rank = 1").select("posting_id")
        options = F.sort_array(F.collect_list(F.struct("application_id", "twin")))
        torn = marked.filter("best").join(first, "posting_id", "left_semi").groupBy("posting_id").agg(options.alias("o"))
        rivals = F.filter("o", lambda x: (x["twin"] != F.get("o", 0)["twin"]) | (x["application_id"] == F.get("o", 0)["application_id"]))
        torn = cut_lineage(torn.select("posting_id", F.transform(rivals, lambda x: x["application_id"]).alias("ambiguous")))
        done.append(taken)
        open_.append(torn)
        live = live.join(taken.select("posting_id").unionByName(torn.select("posting_id")), "posting_id", "left_anti")
        live = cut_lineage(live.join(taken.select("application_id"), "application_id", "left_anti"))
    none = pairs.filter(F.lit(False))
    return _union(done, none.select("posting_id", "application_id")), _union(open_, none.select("posting_id", F.array("application_id").alias("ambiguous")))
