"""Conditions with the catalogue's rules for what is unknown: an unknown value never excludes a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a posting stays visible, and the shorter lens for what is new.
VISIBLE_DAYS, NEW_DAYS = 30, 14
#: Upper edges, in days, of the age bands.
BANDS = (3, 7, 14, 30)


def all_of(conditions: Iterable[Column | None]) -> Column:
    """The conjunction of what is asked for; nothing asked for keeps everything."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def member_or_unknown(array: Column, wanted: Sequence[str], anything: str = "ANY") -> Column:
    """The array is unknown, or names one of the wanted, or says that anything will do."""
    return array.isNull() | F.arrays_overlap(array, F.array(*map(F.lit, [*wanted, anything])))


def recency_reference(published: Column, updated: Column, first_seen: Column) -> tuple[Column, Column]:
    """The first known date, and the name of it."""
    basis = F.when(published.isNotNull(), "published").when(updated.isNotNull(), "updated").when(first_seen.isNotNull(), "first_seen")
    return F.coalesce(published, updated, first_seen), basis


def recently_visible(reference: Column, exempt: Column, valid_through: Column, now: Column, days: int = VISIBLE_DAYS) -> Column:
    """Young enough, or exempt, or with a deadline still to come."""
    young = reference >= now - F.expr(f"INTERVAL '{days}' DAY")
    return F.coalesce(young, F.lit(False)) | F.coalesce(exempt, F.lit(False)) | F.coalesce(valid_through > now, F.lit(False))


def recency_decision(published: Column, updated: Column, first_seen: Column, exempt: Column, valid_through: Column, now: Column, days: int = VISIBLE_DAYS) -> Column:
    """struct<visible, effective, basis, estimated>."""
    reference, basis = recency_reference(published, updated, first_seen)
    return F.struct(recently_visible(reference, exempt, valid_through, now, days).alias("visible"), reference.alias("effective"), basis.alias("basis"), (basis != "published").alias("estimated"))


def recency_band(date: Column, today: Column) -> Column:
    """0 to 4 by age in days; null without a date or with one to come."""
    age = F.datediff(today, date)
    band = F.when(age < 0, F.lit(None).cast("int"))
    for k, edge in enumerate(BANDS):
        band = band.when(age <= edge, k)
    return F.when(age.isNotNull(), band.otherwise(len(BANDS)))


def ordinal(column: Column, ranks: Sequence[str]) -> Column:
    """Place in a list of names; unlisted names come last."""
    found = F.when(column == ranks[0], 0)
    for k, name in enumerate(ranks[1:], 1):
        found = found.when(column == name, k)
    return found.otherwise(len(ranks))


def contains_any(text: Column, hints: Sequence[str]) -> Column:
    """One of the hints stands somewhere, whatever its case."""
    return reduce(lambda a, b: a | b, [F.lower(text).contains(h.lower()) for h in hints], F.lit(False))


def infer_unique(flags: dict[str, Column]) -> Column:
    """The one class whose evidence is there; none, or evidence for several, is UNKNOWN."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, found[0]).otherwise("UNKNOWN")


def known_compensation(currency: Column, period: Column, low: Column, high: Column) -> Column:
    return currency.isNotNull() & (F.coalesce(period, F.lit("UNKNOWN")) != "UNKNOWN") & (low.isNotNull() | high.isNotNull())


def homologated(manual: Column, gates: Sequence[Column]) -> Column:
    """Approved by hand, or by every gate."""
    return F.coalesce(manual, F.lit(False)) | all_of([F.coalesce(g, F.lit(False)) for g in gates])


def unknown_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields whose value is UNKNOWN or missing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("UNKNOWN")) == "UNKNOWN", F.lit(n)) for n, c in fields.items()]))
