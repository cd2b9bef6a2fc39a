"""Aggregates with the exact rules of reports: rates, percentiles of four kinds, streaks, shares, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """Null when there is nothing to measure; a measured zero stays zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def continuous(column: Column | str, p: float) -> Column:
    """Linear between ranks."""
    return F.percentile(column, F.lit(p))


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def rounded_index(df: DataFrame, keys: Sequence[str], column: str, p: float) -> DataFrame:
    """(keys, value) at index round(p * (n - 1)), half to even, of each group's known values: values are counted, and the counts added up in their order, so no group is gathered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy("value")
    rows = counts.withColumns({"_to": F.sum("_n").over(ordered), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    wanted = F.bround(p * (F.col("_all") - 1), 0) + 1
    return rows.where((F.col("_to") >= wanted) & (F.col("_to") - F.col("_n") < wanted)).select(*keys, "value")


def at_least(n: int, count: Column, value: Column) -> Column:
    """A measure with too few samples is null."""
    return F.when(count >= n, value)


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts by value within each group, and their share of the group in per cent."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


def share_of_last(df: DataFrame, key: str, order: Sequence[Column], n: int, part: str, whole: str) -> DataFrame:
    """Ratio of sums over the last n rows of each key; null with fewer rows."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    last = df.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return last.groupBy(key).agg(F.when(F.count(F.lit(1)) >= n, rate(F.sum(part), F.sum(whole))).alias("share"), F.count(F.lit(1)).alias("n_runs"))


def failure_streak(df: DataFrame, key: str, order: Sequence[Column], failed: Column, terminal: Column, last: int) -> DataFrame:
    """How many of a key's newest rows failed in a row. Rows still under way are passed over; any other outcome ends the streak."""
    newest = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumns({"_rank": F.row_number().over(newest), "_failed": failed, "_terminal": terminal}).where(F.col("_rank") <= last)
    broken = F.sum((F.col("_terminal") & ~F.col("_failed")).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_broken", broken).groupBy(key).agg(F.count_if(F.col("_failed") & (F.col("_broken") == 0)).alias("streak"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of counts, each stage among those that passed all before it, in one pass."""
    passed, counts = F.lit(True), []
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)


def batch_counts(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Different keys that meet each condition, as a row for each: first a flag per key, then one count, so that many conditions cost one shuffle."""
    flags = df.groupBy(key).agg(*[F.bool_or(c).alias(n) for n, c in conditions.items()])
    counts = flags.agg(*[F.count_if(F.col(n)).alias(n) for n in conditions])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*conditions))).alias("query", "n"))
