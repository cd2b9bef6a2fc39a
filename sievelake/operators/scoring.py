"""Scoring against a preference profile: four-valued filters, eight weighted factors, what is missing, and the verdict.

All in exact decimals; only the stored score is rounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE, UNKNOWN, NOT_APPLICABLE = "TRUE", "FALSE", "UNKNOWN", "NOT_APPLICABLE"
#: Twelve places survive products and quotients in Spark's 38 digits; the score is rounded once, to four.
EXACT = "decimal(20,12)"


def number(x: float | str) -> Column:
    return F.lit(str(x)).cast(EXACT)


@dataclass(frozen=True)
class Factor:
    name: str
    weight: str
    missing: str = "NEUTRAL"


#: Factors, weights and what a missing one does; neutral score, cut-offs and level cap.
FACTORS = (
    Factor("GEOGRAPHY_CONTRACT_FIT", "0.15"), Factor("TECHNOLOGY_FIT", "0.25"), Factor("COMPANY_PRIORITY", "0.10"), Factor("DOMAIN_EXPERIENCE", "0.20"),
    Factor("SENIORITY_SCOPE", "0.15"), Factor("CONTRACT_COMPENSATION", "0.05", "EXCLUDE"), Factor("TIMEZONE", "0.05", "EXCLUDE"), Factor("RECENCY", "0.05"),
)
NEUTRAL = "0.45"
HIGH_PRIORITY, RECOMMENDED, WATCHLIST = 80, 65, 50


@dataclass(frozen=True)
class RuleSet:
    """A version of the rules: replaying an old one gives the old scores."""

    version: str
    neutral: str = NEUTRAL
    excludes: bool = True


#: The current rules, and the older ones that knew no exclusion and scored the unknown a half.
CURRENT, OLD = RuleSet("v6"), RuleSet("v5", "0.5", False)


def known(condition: Column) -> Column:
    """A condition as one of TRUE, FALSE and UNKNOWN."""
    return F.when(condition.isNull(), UNKNOWN).when(condition, TRUE).otherwise(FALSE)


def eligibility(filters: list[Column]) -> Column:
    """Any FALSE is out; else any UNKNOWN is unknown."""
    found = F.array(*filters)
    return F.when(F.array_contains(found, FALSE), "INELIGIBLE").when(F.array_contains(found, UNKNOWN), "UNKNOWN").otherwise("ELIGIBLE")


def country_filter(allowed: Column, home: str, needs_sponsor: bool = False) -> Column:
    unknown = UNKNOWN if needs_sponsor else NOT_APPLICABLE
    return F.when(allowed.isNull(), unknown).when(F.arrays_overlap(allowed, F.array(F.lit(home), F.lit("ANY"))), TRUE).otherwise(FALSE)


def active_filter(status: Column) -> Column:
    return F.when(status.isin("DISCOVERED", "ACTIVE"), TRUE).when(status == "STALE", UNKNOWN).otherwise(FALSE)


def choice_filter(value: Column, accepted: list[str]) -> Column:
    return F.when(F.coalesce(value, F.lit("UNKNOWN")) == "UNKNOWN", UNKNOWN).when(value.isin(*accepted), TRUE).otherwise(FALSE)


def timezone_filter(overlap_hours: Column, required_hours: Column) -> Column:
    return F.when(overlap_hours.isNull() & required_hours.isNull(), NOT_APPLICABLE).otherwise(known(overlap_hours >= required_hours))


def geography(mode: Column, country: Column, contract: Column) -> tuple[Column, Column]:
    """(raw, confidence): nothing if one is FALSE; else the mean over the three, the unknown ones neutral."""
    parts = [mode, country, contract]
    n_known = reduce(lambda a, b: a + b, [F.when(p.isin(TRUE, FALSE), 1).otherwise(0) for p in parts])
    mean = reduce(lambda a, b: a + b, [F.when(p == TRUE, number(1)).otherwise(number(NEUTRAL)) for p in parts]) / 3
    any_false = reduce(lambda a, b: a | b, [p == FALSE for p in parts])
    return F.when(any_false, number(0)).when(n_known > 0, mean).cast(EXACT), F.when(n_known > 0, (n_known / F.lit(3).cast(EXACT)).cast(EXACT)).otherwise(number(0))


def technology(required: Column, preferred: Column, have: Column) -> Column:
    """.8 of the required, .2 of the preferred; only one side stated counts alone."""
    share = lambda wanted: F.when(F.size(wanted) > 0, (F.size(F.array_intersect(wanted, have)).cast(EXACT) / F.size(wanted)).cast(EXACT))
    r, p = share(required), share(preferred)
    return F.when(r.isNotNull() & p.isNotNull(), (number("0.8") * r + number("0.2") * p).cast(EXACT)).otherwise(F.coalesce(r, p))


def company_priority(priority: Column) -> Column:
    return F.when(priority == "HIGH", number(1)).when(priority == "NORMAL", number("0.7")).when(priority == "LOW", number("0.4")).when(priority == "BLOCKED", number(0))


def domain(family: Column, families: list[str]) -> Column:
    return F.when(F.coalesce(family, F.lit("UNKNOWN")) == "UNKNOWN", F.lit(None)).when(family.isin(*families), number(1)).otherwise(number("0.25"))


def seniority_fit(level: Column, accepted: list[str]) -> Column:
    """Accepted; next to an accepted one below senior; senior and above that is not accepted; else nothing."""
    next_to = F.lit(bool({"JUNIOR", "MID"} & set(accepted))) & level.isin("JUNIOR", "MID")
    senior = level.isin("SENIOR", "LEAD", "STAFF", "PRINCIPAL")
    fit = F.when(level.isin(*accepted), number(1)).when(next_to, number("0.6")).when(senior, number("0.25")).otherwise(number(0))
    return F.when(F.coalesce(level, F.lit("UNKNOWN")) != "UNKNOWN", fit) if accepted else F.lit(None).cast(EXACT)


def compensation_fit(contract: Column, low: Column, high: Column, comparable: Column, wanted_low: float, conflict: Column) -> Column:
    unknown = (contract == UNKNOWN) | conflict | ~comparable | (low.isNull() & high.isNull())
    meets = high.isNull() | (high >= wanted_low)
    return F.when(contract == FALSE, number(0)).when(F.coalesce(unknown, F.lit(True)), F.lit(None)).when(meets, number(1)).otherwise(number(0))


def recency_fit(age_days: Column) -> Column:
    found = F.when(age_days < 0, F.lit(None))
    for edge, value in ((3, "1"), (7, "0.9"), (14, "0.75"), (30, "0.5")):
        found = found.when(age_days <= edge, number(value))
    return F.when(age_days.isNotNull(), found.otherwise(number("0.25")))


def score(raw: dict[str, Column], rules: RuleSet = CURRENT) -> Column:
    """Sum of 100 * weight * raw; an excluded factor's weight leaves the denominator too."""
    total, left = number(0), number(1)
    for f in FACTORS:
        missing = number(rules.neutral) if not (rules.excludes and f.missing == "EXCLUDE") else number(0)
        total = (total + number(f.weight) * F.coalesce(raw[f.name], missing) * 100).cast(EXACT)
        if rules.excludes and f.missing == "EXCLUDE":
            left = (left - F.when(raw[f.name].isNull(), number(f.weight)).otherwise(number(0))).cast(EXACT)
    return F.round((total / left).cast(EXACT), 4).cast("decimal(7,4)")


def confidence(raw: dict[str, Column], geography_confidence: Column) -> Column:
    total = number(0)
    for f in FACTORS:
        sure = geography_confidence if f.name == "GEOGRAPHY_CONTRACT_FIT" else F.when(raw[f.name].isNotNull(), number(1)).otherwise(number(0))
        total = (total + number(f.weight) * sure).cast(EXACT)
    return F.round(total, 4).cast("decimal(5,4)")


def verdict(points: Column, eligible: Column, review: Column, level_outside: Column, level_unknown: Column) -> Column:
    """Out, then review, then the level's cap, then by points."""
    capped = F.when(points >= WATCHLIST, "WATCHLIST").otherwise("LOW_MATCH")
    by_points = F.when(points >= HIGH_PRIORITY, "HIGH_PRIORITY").when(points >= RECOMMENDED, "RECOMMENDED").otherwise(capped)
    return F.when(eligible == "INELIGIBLE", "INELIGIBLE").when(review, "REVIEW_REQUIRED").when(level_outside | level_unknown, capped).otherwise(by_points)


def input_hash(*parts: Column) -> Column:
    """What a score was made from; equal inputs need no second score."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def is_current(same: list[tuple[Column, Column]]) -> Column:
    """All versions, and the age bands, are the same."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in same])
