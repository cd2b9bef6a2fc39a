"""Queues and gates of review: what still needs a suggestion, what is surely another posting, what a rollout has to show."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suggestion_queue(postings: DataFrame, fields: Sequence[str], suggestions: DataFrame, assessments: DataFrame, top: Sequence[str], n: int, after: tuple | None = None) -> DataFrame:
    """(id, created, pending) of the next n postings, by (created, id), that a suggestion could help.

    postings: id, created, version, and the fields, of which one at least is UNKNOWN and has no suggestion for this version;
    suggestions: id, version, field; assessments: id, verdict, of the active profile, current ones only. after: the
    (created, id) that the last page ended with. What is resolved is taken out before the page is cut, so it never fills
    one. A posting without a time comes last; one without an id is left out.
    """
    unknown = F.array_compact(F.array(*[F.when(F.col(f) == "UNKNOWN", F.lit(f)) for f in fields]))
    rows = postings.where("id is not null").select("id", "created", "version", F.explode(unknown).alias("field"))
    if after is not None:
        created, key = F.lit(after[0]).cast(postings.schema["created"].dataType), F.lit(after[1])
        rows = rows.where((F.col("created") > created) | ((F.col("created") == created) & (F.col("id") > key)) | F.col("created").isNull())
    open_ = rows.join(suggestions.select("id", "version", "field").distinct(), ["id", "version", "field"], "left_anti")
    wanted = assessments.where(F.col("verdict").isin(*top)).select("id").distinct()
    pending = open_.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("created").alias("created"), F.array_sort(F.collect_list("field")).alias("pending"))
    return pending.orderBy(F.col("created").asc_nulls_last(), "id").limit(n)


def differs(location: Column, other_location: Column, mode: Column, other_mode: Column) -> Column:
    """Both places are known and not the same, or both ways of work are."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    known = lambda c: some(c) & (c != "UNKNOWN")
    place = some(location) & some(other_location) & (location != other_location)
    return F.coalesce(place, F.lit(False)) | F.coalesce(known(mode) & known(other_mode) & (mode != other_mode), F.lit(False))


def distinct_postings(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, distinct): surely postings of their own, as every candidate is another posting of the same source that differs.

    rows: id, external_id, location, work_mode; candidates: id, of the row it is for, there (whether it still is),
    external_ids, location, work_mode. A row without candidates is not sure, nor is one with a candidate that is gone, has
    no ids of its own, or has the row's.
    """
    other = candidates.select("id", "there", "external_ids", F.col("location").alias("_place"), F.col("work_mode").alias("_mode"))
    met = rows.join(other, "id", "left")
    own = F.coalesce(F.size("external_ids") > 0, F.lit(False)) & ~F.coalesce(F.array_contains("external_ids", F.col("external_id")), F.lit(False))
    sure = F.coalesce("there", F.lit(False)) & own & differs(F.col("location"), F.col("_place"), F.col("work_mode"), F.col("_mode"))
    return met.groupBy("id").agg(F.bool_and(sure).alias("distinct"))


def prompt_budget(most_input: Column | int, most_output: Column | int, margin: Column | None = None) -> Column:
    """Tokens that a prompt may use: the input's, less the answer's, less a margin, of a tenth if none was measured."""
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    tenth = F.floor(whole(most_input) / 10)
    return (whole(most_input) - whole(most_output) - (tenth if margin is None else F.coalesce(margin, tenth))).cast("long")


def estimated_tokens(chars: Column, ratio: Column | float) -> Column:
    return F.ceil(chars * (ratio if isinstance(ratio, Column) else F.lit(ratio))).cast("long")


GATES = T.StructType([T.StructField("gate", T.StringType()), T.StructField("bound", T.DoubleType()), T.StructField("at_least", T.BooleanType())])


def rollout(measures: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, value, passes, ready) of each gate (gate, bound, at_least) by its measure (gate, value): a gate without a measure, with several, or with one that is no number, fails; ready only if all pass."""
    one = measures.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    value = F.when((F.col("n") == 1) & ~F.isnan("value"), F.col("value"))
    rows = gates.join(one, "gate", "left").withColumn("value", value)
    passes = F.coalesce(F.when(F.col("at_least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")), F.lit(False))
    # gates are a short list, whatever was measured
    return rows.withColumn("passes", passes).select("gate", "value", "passes", F.bool_and(passes).over(Window.partitionBy(F.lit(0))).alias("ready"))


def latest_departments(occurrences: DataFrame) -> DataFrame:
    """(id, departments, error) by the newest occurrence of each posting (id, last_seen, occurrence, departments json).

    The departments are a JSON array of names. Evidence that is missing, or is no such array, is an error, not an empty
    list; an empty array is one. Of equal times the greater occurrence counts.
    """
    newest = occurrences.groupBy("id").agg(F.max_by("departments", F.struct("last_seen", "occurrence")).alias("said"))
    names = F.from_json("said", "array<string>")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("said")).startswith("ARRAY"), F.lit(False)) & names.isNotNull()
    return newest.select("id", F.when(ok, F.filter(names, lambda x: x.isNotNull())).alias("departments"), F.when(F.col("said").isNull(), "MISSING").when(~ok, "MALFORMED").alias("error"))


def means(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means of measures by key, over the rows that have them, with their numbers; none if no row has one."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *reduce(lambda a, m: [*a, F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"n_{m}")], measures, []))
