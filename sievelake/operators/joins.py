"""Join shapes: existence flags, intervals, exactly-one matches, list overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_flag(df: DataFrame, having: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """df with a true flag where `having` has its key; no row is doubled."""
    return df.join(having.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def either_side(df: DataFrame, key: str, pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Flags rows whose key is on either side of a pair: the two columns become one, so that the join stays one of equal keys."""
    sides = pairs.select(F.explode(F.array(a, b)).alias(key))
    return with_flag(df, sides, [key], name)


def within(a: DataFrame, b: DataFrame, keys: Sequence[str], a_time: str, b_time: str, seconds: int) -> DataFrame:
    """Pairs with equal keys whose times differ by no more.

    Time is cut into bins of that width: what is near is in the same bin or in one beside it, so a hot key's rows meet bin
    by bin, and never all of them in one task.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = max(1, seconds) * 1_000_000
    bin_of = lambda c: F.floor(micros(c) / F.lit(width))
    left = a.withColumn("_bin", F.explode(F.array(*[bin_of(a_time) + k for k in (-1, 0, 1)])))
    near = F.abs(micros(a_time) - micros(b_time)) <= seconds * 1_000_000
    return left.join(b.withColumn("_bin", bin_of(b_time)), [*keys, "_bin"]).where(near).drop("_bin")


def exactly_one(candidates: DataFrame, key: str, match: str) -> DataFrame:
    """A key's match if it has exactly one different match; ambiguous keys have none."""
    return candidates.groupBy(key).agg(F.count_distinct(match).alias("_n"), F.min(match).alias(match)).where("_n = 1").drop("_n")


def overlaps(low: Column, high: Column, wanted_low: Column | None, wanted_high: Column | None) -> Column:
    """Ranges meet; a missing bound is open."""
    found = F.lit(True)
    if wanted_low is not None:
        found = found & (high.isNull() | (high >= wanted_low))
    if wanted_high is not None:
        found = found & (low.isNull() | (low <= wanted_high))
    return found


def overlap_ratio(wanted: Column, present: Column) -> Column:
    """The share of the wanted items that are present; null if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, present)) / F.size(wanted))


def name_fallback(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_col: str, name_col: str, value: str) -> DataFrame:
    """The value of the linked row, or else of the row with the same normalised name."""
    linked = df.join(by_id.select(id_col, F.col(value).alias("_linked")), id_col, "left")
    named = linked.join(by_name.select(name_col, F.col(value).alias("_named")), name_col, "left")
    return named.withColumn(value, F.coalesce("_linked", "_named")).drop("_linked", "_named")
