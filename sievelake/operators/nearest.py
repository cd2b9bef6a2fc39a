"""Nearest rows by the cosine of their vectors, exactly: blocks of queries meet blocks of entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators.latest import latest_by

#: At most about so many queries, and so many entries, are compared by one task at a time.
BLOCK_ROWS = 2048


def _units(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype="float64")
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(entries: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one block of entries, each query's k nearest; equal distances by the lesser id."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "distance": []}
    if len(entries) and len(queries):
        entries = entries.sort_values("id", ignore_index=True)
        ids = entries["id"].to_numpy()
        asked = queries["id"].to_numpy()
        far = np.round(1 - _units(queries["v"]) @ _units(entries["v"]).T, 6) + 0.0
        far[asked[:, None] == ids[None, :]] = np.inf
        edges = np.partition(far, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(asked), np.inf)
        for q, row, edge in zip(asked, far, edges):
            near = np.flatnonzero((row <= edge) & (row < np.inf))
            for j in near[np.argsort(row[near], kind="stable")[:k]]:
                out["query_id"].append(q)
                out["vec_id"].append(ids[j])
                out["distance"].append(row[j])
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})


def nearest_by_cosine(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest of all rows to each row that is a query, itself left out.

    Rows without an id or whose vector has no direction (missing, infinite or no length) have no distance, nor have
    vectors of different dimensions.
    """
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)
    rows = rows.withColumn("dim", F.size("v"))
    counts = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks = [max(1, -(-n // block_rows)) for n in counts]
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = rows.select("id", "v", "dim", part(blocks[0]).alias("eb"), every(blocks[1]).alias("qb"))
    queries = rows.where("asked").select("id", "v", "dim", part(blocks[1]).alias("qb"), every(blocks[0]).alias("eb"))
    keys = ["dim", "eb", "qb"]
    found = entries.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(lambda e, q: _nearest(e, q, k), "query_id long, vec_id long, distance double")
    return latest_by(found, ["query_id"], [F.col("distance"), F.col("vec_id")], k)
