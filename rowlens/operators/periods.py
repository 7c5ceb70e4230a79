"""Postings kept as a table by period of first sight, of which a batch or purge rewrites only the periods that it changes.

A posting's first sight never changes, so it stays in its period. A change is
found on narrow columns, its periods are read, and their new rows are written
to a stage beside the table. Then a line in the log says which periods the
stage replaces, they are overwritten (dynamic partition overwrite, emptied ones
are deleted), and a second line says so. A change that stopped between the two
lines is repeated from its stage by ``recover``, which every change calls first:
overwriting a period twice gives the same rows. There is one writer at a time.

What comes to the driver are names of periods, one a month by default. Rows
without a first sight are in the period ``none``. A period's rows are spread by
id over ``SPREAD`` tasks, so that no period, however full, is one task's.
"""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.operators.retention import kept_postings
from rowlens.operators.snapshot import apply_batch

SPREAD = 8
PERIOD = "seen_period"
LOG = "number long, state string, stage string, periods array<string>, at timestamp"


class PeriodTable:
    """Postings under ``path``; ``columns`` is their schema as DDL, ``unit`` the date pattern of a period."""

    def __init__(self, spark: SparkSession, path: str, columns: str, unit: str = "yyyy-MM"):
        self.spark, self.path, self.columns, self.unit = spark, path.rstrip("/"), columns, unit

    def _period(self) -> Column:
        return F.coalesce(F.date_format("first_seen_at", self.unit), F.lit("none"))

    def _spread(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(PERIOD, self._period())
        return rows.repartition(F.col(PERIOD), F.pmod(F.xxhash64("posting_id"), F.lit(SPREAD)))

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, {PERIOD} string").parquet(path)

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _note(self, number: int, state: str, stage: str, periods: list[str]) -> None:
        line = self.spark.createDataFrame([(number, state, stage, periods)], "number long, state string, stage string, periods array<string>")
        line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{number:012d}-{state}")

    def create(self, postings: DataFrame) -> PeriodTable:
        self._spread(postings).write.partitionBy(PERIOD).parquet(f"{self.path}/rows")
        self._note(0, "done", "", [])
        return self

    def read(self) -> DataFrame:
        """The postings, with their period."""
        return self._stored(f"{self.path}/rows")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{self.path}/log")

    def _replace(self, rows: DataFrame, periods: list[str]) -> None:
        """The rows in place of those of the periods; without a period nothing happens."""
        if not periods:
            return
        number = self.log().agg(F.max("number")).first()[0] + 1
        stage = f"{self.path}/stage/{uuid4().hex}"
        self._spread(rows.select(*[c for c in rows.columns if c != PERIOD])).write.partitionBy(PERIOD).parquet(stage)
        self._note(number, "staged", stage, periods)
        self._swap(number, stage, periods)

    def _swap(self, number: int, stage: str, periods: list[str]) -> None:
        rows = self._stored(stage)
        left = {r[0] for r in rows.select(PERIOD).distinct().collect()}
        self._spread(rows.drop(PERIOD)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(f"{self.path}/rows")
        for period in set(periods) - left:
            files, path = self._path(f"{self.path}/rows/{PERIOD}={period}")
            files.delete(path, True)
        self._note(number, "done", stage, periods)
        files, path = self._path(stage)
        files.delete(path, True)

    def recover(self) -> None:
        """Ends the change that was staged but not done, if there is one."""
        last = self.log().groupBy("number").agg(F.count_if(F.col("state") == "done").alias("done"), F.max("stage").alias("stage"), F.first("periods").alias("periods"))
        for r in last.filter("done = 0").orderBy("number").collect():
            self._swap(r.number, r.stage, r.periods)

    def _names(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(PERIOD).distinct().collect())

    def apply(self, batch: DataFrame) -> list[str]:
        """Applies a batch as ``apply_batch`` does; the periods rewritten."""
        self.recover()
        narrow = self.read().select("posting_id", "fingerprint", PERIOD)
        ids = batch.select("posting_id").distinct()
        # a record stored under another fingerprint stays in that group
        named = batch.select("fingerprint").unionByName(narrow.join(ids, "posting_id", "left_semi").select("fingerprint")).distinct()
        touched = narrow.join(named, "fingerprint", "left_semi").select(PERIOD)
        new = batch.join(narrow.select("posting_id"), "posting_id", "left_anti").select(self._period().alias(PERIOD))
        periods = self._names(touched.unionByName(new))
        rows = self.read().filter(F.col(PERIOD).isin(periods)).drop(PERIOD)
        self._replace(apply_batch(rows, batch)[0], periods)
        return periods

    def purge(self, flags: DataFrame, applications: DataFrame, as_of: datetime | str) -> list[str]:
        """Drops what ``kept_postings`` doesn't keep; the periods rewritten."""
        self.recover()
        narrow = self.read().select("posting_id", "is_active", "last_seen_at", PERIOD)
        kept = kept_postings(narrow, flags, applications, as_of).select("posting_id")
        periods = self._names(narrow.join(kept, "posting_id", "left_anti"))
        rows = self.read().filter(F.col(PERIOD).isin(periods))
        self._replace(kept_postings(rows, flags, applications, as_of), periods)
        return periods
