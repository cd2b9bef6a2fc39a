"""Streams of evidence: bronze to silver in micro-batches, windows over late data, incidents as keyed state.

Every stream has a batch twin in the operators, and a test that both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelake.operators.evidence import EvidenceStore
from sievelake.operators.state import ingest


def event_time(df: DataFrame) -> DataFrame:
    """One time for the watermark: published, else updated, else fetched."""
    return df.withColumn("event_time", F.coalesce("published_at", "updated_at", "fetched_at"))


SILVER = "identity string, payload_hash string, semantic_hash string, stored_at timestamp, batch_id long"


def to_silver(bronze: DataFrame, silver: str, observations: str, stale_before: Column, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch against the evidence stored so far: new evidence is a version more of the store, and everything is observed.

    Of the store only files that may hold one of the batch's identities are read. The store is made if it is not there. A
    batch that is run again after a failure finds its own evidence by its name, and its observations once more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = EvidenceStore(batch.sparkSession, silver, SILVER)
        batch = batch.persist()
        known = store.lookup(batch).where(F.col("batch_id") < batch_id)
        outcome = ingest(batch, known, stale_before).persist()
        new = outcome.where("outcome = 'NEW'").select("identity", "payload_hash", "semantic_hash", F.col("fetched_at").alias("stored_at"), F.lit(batch_id).cast("long").alias("batch_id"))
        store.append(new, f"batch-{batch_id}")
        outcome.select("identity", "payload_hash", "fetched_at", "outcome", F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{observations}/batch={batch_id}")
        outcome.unpersist()
        batch.unpersist()

    return bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tumbling(df: DataFrame, time: str, late: str, window: str, keys: list[str]) -> DataFrame:
    """Counts and sums by window; what is later than the watermark is dropped."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), key, "n")


def deduplicated(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


INCIDENT = "source_id long, opened timestamp, closed timestamp, failures long"


def incidents(runs: DataFrame, threshold: int = 2) -> DataFrame:
    """Opened by so many failures in a row, closed by the next success. runs: source_id, ts, failed. Rows come as incidents close."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, opened = state.get if state.exists else (0, None)
        done = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, failed in zip(rows["ts"], rows["failed"], strict=True):
            if failed:
                n, opened = n + 1, opened if n else ts
            else:
                if n >= threshold:
                    done.append((key[0], opened, ts, n))
                n, opened = 0, None
        state.update((n, opened))
        if done:
            yield pd.DataFrame(done, columns=["source_id", "opened", "closed", "failures"])

    return runs.groupBy("source_id").applyInPandasWithState(step, INCIDENT, "n long, opened timestamp", "append", GroupStateTimeout.NoTimeout)


def closed_incidents(runs: DataFrame, threshold: int = 2) -> DataFrame:
    """The batch twin: stretches of failures between successes, by gaps and islands."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("ts")
    island = F.sum((~F.col("failed")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("island", F.coalesce(island, F.lit(0)))
    found = rows.groupBy("source_id", "island").agg(F.min(F.when(F.col("failed"), F.col("ts"))).alias("opened"), F.max(F.when(~F.col("failed"), F.col("ts"))).alias("closed"), F.count_if("failed").alias("failures"))
    return found.where((F.col("failures") >= threshold) & F.col("closed").isNotNull()).select("source_id", "opened", "closed", "failures")
