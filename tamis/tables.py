"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Removes a statement's shuffle files as soon as it has ended; what is saved needs them no more.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SAVED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, on one machine only (``local`` masters, as in tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def place(spark: SparkSession) -> str:
    """A new path there, removed at the end."""
    path = f"{shared_dir(spark)}/tamis/{uuid.uuid4().hex}"
    _SAVED.append((spark, path))
    return path


def save(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` there and read it back: lineage is cut, the planner knows its size, and the shuffles that led to it go at once."""
    spark = df.sparkSession
    path = place(spark)
    had = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANED) if had is None else spark.conf.set(CLEANED, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._tamis_path = path
    return out


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows``, saved in order, with their places from 0 on as ``name`` (a long).

    Ranges of the order are sorted and written, a file each; places follow from the files' counts
    (a row a file) and the rows' places in them, so that no task sees more than its range.
    """
    made = save(rows.orderBy(*order))
    placed = made.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_"), F.col("_metadata.row_index").alias("nth_"))
    before = F.sum("rows_").over(Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1))
    files = placed.groupBy("file_").agg(F.count("*").alias("rows_")).coalesce(1).select("file_", F.coalesce(before, F.lit(0)).alias("base_"))
    return placed.join(save(files), "file_").select(*rows.columns, (F.col("base_") + F.col("nth_")).alias(name))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str, size: str) -> DataFrame:
    """``rows`` with their places from 0 on within ``group`` (``name``) and the group's number of rows (``size``), in two levels: no group has to fit one task."""
    placed = numbered(rows.withColumn("group_", F.col(group)), ["group_", *order], "place_")
    starts = placed.groupBy("group_").agg(F.min("place_").alias("start_"), F.count("*").alias(size)).withColumnRenamed("group_", "of_")
    return placed.join(starts, F.col("group_").eqNullSafe(F.col("of_"))).select(*rows.columns, (F.col("place_") - F.col("start_")).alias(name), size)


def drop(*frames: DataFrame) -> None:
    """Remove tables written by ``save`` that no later plan reads."""
    for df in frames:
        _remove(df.sparkSession, df._tamis_path)
        _SAVED.remove((df.sparkSession, df._tamis_path))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_end() -> None:
    for spark, path in _SAVED:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may have gone first
            return
