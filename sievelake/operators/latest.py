"""Latest rows, pages, folded groups and queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order. Spark cuts each task's groups to n before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order: a top-k in each task, then of those; never a global sort."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[Column], limit: int) -> DataFrame:
    """The rows after a cursor, in the order of the keys."""
    return df.where(F.struct(*keys) > F.struct(*[c.alias(k) for c, k in zip(after, keys, strict=True)])).orderBy(*keys).limit(limit)


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each group, with how many more the group has."""
    by = Window.partitionBy(*keys)
    return df.withColumns({"_rank": F.row_number().over(by.orderBy(*order)), "sibling_count": (F.count(F.lit(1)).over(by) - 1).cast("long")}).where("_rank = 1").drop("_rank")


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """A page's rows, each with the one row of totals; an empty page leaves the totals to be asked for by themselves."""
    return rows.join(F.broadcast(totals), how="cross")  # totals: one aggregated row


def value_queue(df: DataFrame, value: Sequence[Column], age: Sequence[Column], limit: int, reserved: int, key: str) -> DataFrame:
    """The most valuable rows, and a reserved slice of the longest waiting ones outside of them."""
    top = df.orderBy(*value).limit(limit - reserved)
    rest = df.join(top.select(key), key, "left_anti").orderBy(*age).limit(reserved)
    return top.withColumn("lane", F.lit("value")).unionByName(rest.withColumn("lane", F.lit("aging")))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows that look random and are the same every time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def rotated(terms: Sequence[str], block: int, turn: int) -> list[str]:
    """The block of terms whose turn it is, over the end and on from the start."""
    if not terms:
        return []
    start = (turn * block) % len(terms)
    doubled = [*terms, *terms]
    return doubled[start : start + min(block, len(terms))]
