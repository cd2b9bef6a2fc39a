"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own centroids, so that K centroids a half give K * K cells; K
grows with the square root of the entries. A query walks the cells in the order of the summed distances of their two
centroids, by a heap, until the cells it has passed hold enough entries; those are ranked by the exact distance on the
original vectors.

How many entries are enough is measured, not set: TRIALS vectors find their exact neighbours among all entries, in one
pass whose cost is linear in them, and the walk is as long as the share GOAL of those neighbours needs. Where vectors
have structure, that is a number that hardly depends on the entries; where they have none, no partition of space tells
near from far, and the number grows with them.

Centroids are fitted on a bounded sample (SAMPLE vectors, by a hash of their number); every row is indexed. Cells lie one
after the other on a line, nearby ones of the first half together, which is cut into blocks of about BLOCK entries, a
large cell into several; queries lie on the same line in blocks of QUERY_BLOCK. An entry goes only to those blocks of
queries that probe its block, so a task holds neither all entries nor all queries. Of equal vectors only as many as an
answer can hold, those with the smallest ids, are entries; no answer needs more of them, and one vector that is a third
of all rows is no hot cell.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries or entries; nor do rows
without an id. Vectors of different lengths have no distance: each length is searched by itself. Ties go to the smaller id.
Rows are told apart by numbers of their own: each row of a repeated id is a query if it is one, and an entry for all rows
but itself. With fewer entries than asked for, all are returned. An empty table gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import fresh, written

SAMPLE, TRIALS, GOAL = 16_384, 256, 0.95
#: Cells are as many as there are entries by ENTRIES_A_CELL, up to MOST_K a half: the driver holds a count for each cell.
ENTRIES_A_CELL, LEAST_K, MOST_K = 4, 4, 1_024
#: A walk passes so many times the neighbours asked for at least.
LEAST_PASSED = 100
BLOCK, QUERY_BLOCK = 4_096, 1_024
LLOYD_ROUNDS = 12


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (x.shape[1] + 1) // 2
    return x[:, :middle], x[:, middle:]


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random distinct rows; an empty cluster keeps its centroid."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(LLOYD_ROUNDS):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def cells_of(x: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    a, b = halves(x)
    return squares(a, c1).argmin(1).astype("int64") * len(c2) + (squares(b, c2).argmin(1) if b.shape[1] else 0)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells in the order of d1 + d2 until they hold `enough` entries. Empty cells are passed over."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, found, total = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if counts[cell]:
            found.append(cell)
            total += int(counts[cell])
        if j + 1 < len(o2):
            heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
    return found


def ordered(c: np.ndarray) -> np.ndarray:
    """Centroids along the direction in which they differ most, so that neighbours have nearby numbers."""
    if c.shape[1] == 0 or len(c) < 3:
        return c
    centred = c - c.mean(0)
    return c[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]


def exact_neighbours(entries: DataFrame, trials: pd.DataFrame, cell, k: int) -> pd.DataFrame:
    """(trial, cell) of the k nearest entries of each trial vector, of all entries: each task keeps the best it has seen."""
    t, t_rows = np.stack(trials["v"].to_numpy()), trials["row"].to_numpy()

    def run(batches):
        d, ids, cells = (np.zeros((len(t), 0), kind) for kind in ("float64", "int64", "int64"))
        for batch in batches:
            if not len(batch):
                continue
            new = squares(t, np.stack(batch["v"].to_numpy()))
            own = np.broadcast_to(batch["row"].to_numpy(), new.shape)
            new[own == t_rows[:, None]] = np.inf
            d, ids, cells = (np.concatenate(x, axis=1) for x in ((d, new), (ids, own), (cells, np.broadcast_to(batch["cell"].to_numpy(), new.shape))))
            if d.shape[1] > k:
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, ids, cells = (np.take_along_axis(x, at, 1) for x in (d, ids, cells))
        trial, _ = np.nonzero(np.isfinite(d))
        yield pd.DataFrame({"trial": trial, "d": d[np.isfinite(d)], "row": ids[np.isfinite(d)], "cell": cells[np.isfinite(d)]})

    best = Window.partitionBy("trial").orderBy("d", "row")
    found = entries.select("row", "v", cell("v").alias("cell")).mapInPandas(run, "trial long, d double, row long, cell long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("trial", "cell").toPandas()  # TRIALS * k rows


def entries_needed(trials: pd.DataFrame, near: pd.DataFrame, c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, goal: float) -> int:
    """How many entries a walk must pass so that it meets the share `goal` of the trials' exact neighbours."""
    a, b = halves(np.stack(trials["v"].to_numpy()))
    passed: list[int] = []
    for trial, cells in near.groupby("trial")["cell"]:
        d = (squares(a[trial : trial + 1], c1)[0][:, None] + (squares(b[trial : trial + 1], c2)[0] if b.shape[1] else np.zeros(1))[None]).ravel()
        order = np.argsort(d, kind="stable")
        reach = np.empty(len(d), "int64")
        reach[order] = np.cumsum(counts[order])
        passed += reach[cells.to_numpy()].tolist()
    return int(np.quantile(passed, goal, method="higher")) if passed else 0


def line(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last block that each cell reaches over, if all cells lie one after the other."""
    ends = np.cumsum(counts)
    first = (ends - counts) // block
    return first, np.maximum(first, (ends - 1) // block)


def by_cell(rows: DataFrame, cell, n_cells: int) -> np.ndarray:
    """Rows in each cell; a row for each cell at most comes to the driver."""
    counts = np.zeros(n_cells, "int64")
    found = rows.groupBy(cell("v").alias("cell")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts[found["cell"].to_numpy("int64")] = found["n"].to_numpy("int64")
    return counts


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id, score) of each query's k nearest rows by Euclidean distance."""
    spark = df.sparkSession
    flag = fresh(df, "query")
    rows = df.withColumn(flag, is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(F.col(flag), F.lit(False)).alias("q")).where(valid(F.col("v")) & F.col("id").isNotNull())
    # rows have numbers of their own: an id may be several rows
    named = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = named.groupBy(F.size("v").alias("d")).agg(F.max("q").alias("asked")).where("asked").orderBy("d").collect()
    found = [of_length(named.where(F.size("v") == r.d), id_col, k) for r in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")


def of_length(named: DataFrame, id_col: str, k: int) -> DataFrame:
    """search() among vectors (row, id, v, q) of one length."""
    copies = Window.partitionBy("v").orderBy("id", "row")
    entries = written(named.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("row", "id", "v"), "entries")
    total = entries.count()

    share = F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < math.ceil(1e6 * SAMPLE / total)
    sample = entries.where(share).orderBy(F.xxhash64("row", F.lit(1)), "row").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = entries.orderBy("row").limit(1).toPandas()
    # what the walk's length is measured by are other vectors than those that the centroids were fitted to, if there are any
    trials = entries.where(~share).orderBy(F.xxhash64("row", F.lit(2)), "row").limit(TRIALS).toPandas()
    if not len(trials):
        trials = sample.iloc[:TRIALS]
    x = np.stack(sample["v"].to_numpy())
    size = max(LEAST_K, min(MOST_K, round(math.sqrt(total / ENTRIES_A_CELL))))
    a, b = halves(x)
    c1 = ordered(centroids(a, size, 1))
    c2 = ordered(centroids(b, size, 2)) if b.shape[1] else np.zeros((1, 0))
    n_cells = len(c1) * len(c2)

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells_of(np.stack(vectors.to_numpy()), c1, c2)) if len(vectors) else pd.Series([], dtype="int64")

    counts = by_cell(entries, cell, n_cells)
    enough = max(entries_needed(trials, exact_neighbours(entries, trials, cell, k), c1, c2, counts, GOAL), LEAST_PASSED * k)
    first, last = line(counts, BLOCK)
    q_first, q_last = line(by_cell(named.where("q"), cell, n_cells), QUERY_BLOCK)

    def dealt(first: np.ndarray, last: np.ndarray):
        @F.pandas_udf("long")
        def block_of(cells: pd.Series, salts: pd.Series) -> pd.Series:
            c = cells.to_numpy()
            return pd.Series(first[c] + salts.to_numpy() % (last[c] - first[c] + 1))

        return lambda c: block_of(c, F.pmod(F.xxhash64("row"), F.lit(1 << 30)))

    def routes(batches):
        for batch in batches:
            for q, i, v, home in zip(batch["row"], batch["id"], batch["v"], batch["qblock"], strict=True):
                p, s = halves(v[None])
                probed = np.array(walk(squares(p, c1)[0], squares(s, c2)[0] if s.shape[1] else np.zeros(1), counts, enough))
                spans = last[probed] - first[probed] + 1
                cells = np.repeat(probed, spans)
                blocks = np.repeat(first[probed], spans) + np.arange(len(cells)) - np.repeat(np.cumsum(spans) - spans, spans)
                order = np.argsort(blocks, kind="stable")
                starts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
                yield pd.DataFrame({"qrow": q, "query_id": i, "qv": [v] * len(starts), "cells": np.split(cells[order], starts[1:]), "block": blocks[order][starts], "qblock": home})

    asked = named.where("q").select("row", "id", "v", cell("v").alias("cell")).withColumn("qblock", dealt(q_first, q_last)(F.col("cell"))).select("row", "id", "v", "qblock")
    queries = written(asked.mapInPandas(routes, "qrow long, query_id long, qv array<double>, cells array<long>, block long, qblock long"), "routes")
    filed = entries.withColumn("cell", cell("v")).withColumn("block", dealt(first, last)(F.col("cell")))
    probes = queries.select(F.col("block").alias("probed"), F.col("qblock").alias("by")).distinct()
    filed = filed.join(probes, F.col("block") == F.col("probed")).select("row", "id", "v", "cell", "block", F.col("by").alias("qblock"))

    def rank(_, qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(es):
            es = es.sort_values(["cell", "id", "row"])
            x, ids, names = np.stack(es["v"].to_numpy()), es["id"].to_numpy(), es["row"].to_numpy()
            own, of = np.unique(es["cell"].to_numpy(), return_inverse=True)
            for q, i, v, probed in zip(qs["qrow"], qs["query_id"], qs["qv"], qs["cells"], strict=True):
                hit = np.zeros(len(own) + 1, bool)
                place = np.searchsorted(own, probed)
                hit[place[own[np.minimum(place, len(own) - 1)] == probed]] = True
                at = np.flatnonzero(hit[of])
                at = at[names[at] != q]
                d = np.sqrt(((x[at] - v) ** 2).sum(1))
                if len(at) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[near], d[near]
                best = np.lexsort((ids[at], d))[:k]
                found += zip([q] * len(best), [i] * len(best), ids[at][best].tolist(), d[best].tolist())
        return pd.DataFrame(found, columns=["qrow", "query_id", "id", "score"]).astype({"qrow": "int64", "query_id": "int64", "id": "int64", "score": "float64"})

    near = queries.groupBy("block", "qblock").cogroup(filed.groupBy("block", "qblock")).applyInPandas(rank, "qrow long, query_id long, id long, score double")
    best = Window.partitionBy("qrow").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
