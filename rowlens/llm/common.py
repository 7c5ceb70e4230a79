"""Written stages in the shared folder, and frames reduced to the columns an operator needs."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}

#: Rows that a Python worker gets at once where whole texts go to it.
ARROW_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine (master ``local``) that names none gets a temporary
    one; on a cluster, where executors could not read that, a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="rowlens-")
    return _OWN_DIRS[app]


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """From now on Python workers of this session get at most so many rows at once; a smaller setting stays.

    An executor holds a batch several times (Arrow vectors, the stream to the worker, the worker's
    copy), so Spark's 10,000 rows are hundreds of MB where rows are whole texts.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write a stage once and read it back: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """The name, made longer until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (column ``doc_id``; null equals null), with their columns as they are."""
    kept = unused("__kept_id", docs)
    right = ids.select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(right, F.col(f"`{id_col}`").eqNullSafe(F.col(kept)), "left_semi")
