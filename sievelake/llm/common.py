"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that Python workers hold at once; at Arrow's own 10,000, long texts and what is made of them fill an executor.
BATCH_ROWS = "250"


def small_batches(spark: SparkSession) -> None:
    """From now on, the session hands Python workers small batches, unless the user has set a size."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One input table, and small batches for what is done with it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Whether Spark removes what a query has shuffled as the query ends; else it stays until the driver happens to collect its garbage.
REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a query's shuffle files go when it has ended. Only for plans that are run once, as those of writes are."""
    before = spark.conf.get(REMOVED)
    spark.conf.set(REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVED, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, removed when the application ends.

    A lost executor costs only the tasks of the step it ran, and a table that is read twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{k or ''}" for k in range(len(taken) + 1)) if n not in taken)


def discard(table: DataFrame) -> None:
    """Removes a table of written() that no later step reads, before the application ends."""
    jvm = table.sparkSession.sparkContext._jvm
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the other columns of a table that holds each of their keys once, null too, and how many rows have it.

    Keys with so many rows that they would fill a part by themselves, 2 * parts at most, come to the rows by a broadcast;
    the other keys' rows are shuffled to the table.
    """
    parts = partitions(rows.sparkSession)
    table = written(table, "looked-up")
    n_rows = table.agg(F.coalesce(F.sum(count), F.lit(0))).collect()[0][0]
    is_hot = F.col(count) * 2 * parts > n_rows
    keyed = lambda df, *more: df.select(F.col(key).alias("_key"), F.col(key).isNull().alias("_none"), *more)
    others = [c for c in table.columns if c not in (key, count)]
    hot, rest = F.broadcast(keyed(table.where(is_hot), *others)), keyed(table.where(~is_hot), *others)
    same = F.col(key).eqNullSafe(F.col("_key"))
    of_hot = rows.join(hot, same)
    of_rest = rows.join(F.broadcast(keyed(table.where(is_hot))), same, "left_anti").join(rest.hint("merge"), same)
    return of_hot.unionByName(of_rest).drop("_key", "_none")


def counted(found: Counter, name: str) -> Iterator[pd.DataFrame]:
    """What a task has counted, as rows of (name, n); nothing if that is nothing."""
    if found:
        yield pd.DataFrame({name: list(found), "n": list(found.values())})


def partitions(spark: SparkSession) -> int:
    """How many parts the session shuffles to; the user sizes it so that a part fits an executor."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
