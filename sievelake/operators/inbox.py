"""The inbox as a typed query: validated parameters, saved searches from JSON, conditions and the four orders."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import predicates as P
from sievelake.operators.joins import overlaps

#: The orders, and the verdicts that come first by priority.
ORDERS = ("PRIORITY", "SCORE", "RECENCY", "SEARCH")
TOP_VERDICTS = ("HIGH_PRIORITY", "RECOMMENDED")


@dataclass(frozen=True)
class InboxQuery:
    """What a page is asked for; an empty field filters nothing."""

    verdicts: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    salary_min: float | None = None
    salary_max: float | None = None
    currency: str | None = None
    period: str | None = None
    days: int | None = None
    with_closed: bool = False
    order: str = "PRIORITY"
    limit: int = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if (self.salary_min is not None or self.salary_max is not None) and not (self.currency and self.period):
            raise ValueError("a salary bound needs a currency and a period")
        if self.salary_min is not None and self.salary_max is not None and self.salary_min > self.salary_max:
            raise ValueError("salary bounds cross")
        if self.order not in ORDERS:
            raise ValueError(f"unknown order {self.order!r}")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("page out of range")

    @classmethod
    def saved(cls, text: str) -> tuple[InboxQuery | None, str | None]:
        """(query, error) of a saved search: one that can't be read is told, and breaks no list."""
        try:
            given = json.loads(text)
            names = {f.name for f in fields(cls)}
            if not isinstance(given, dict) or set(given) - names:
                return None, "unknown filters"
            return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}), None
        except (ValueError, TypeError) as e:
            return None, str(e)


def pay_fits(q: InboxQuery) -> Column:
    """One of the posting's pays is in the query's own currency and period and meets its range; a missing bound is open. Column: pay, array<struct<low, high, currency, period>>."""
    same = lambda x: (x["currency"] == q.currency) & (x["period"] == q.period) & overlaps(x["low"], x["high"], None if q.salary_min is None else F.lit(q.salary_min), None if q.salary_max is None else F.lit(q.salary_max))
    return F.coalesce(F.exists("pay", same), F.lit(False))


def pay_known() -> Column:
    return F.coalesce(F.exists("pay", lambda x: P.known_compensation(x["currency"], x["period"], x["low"], x["high"])), F.lit(False))


def pay_label(q: InboxQuery) -> Column:
    """matched, or unknown; null if no bound is asked for."""
    asked = q.salary_min is not None or q.salary_max is not None
    return F.when(pay_fits(q), "matched").otherwise("unknown") if asked else F.lit(None).cast("string")


def conditions(q: InboxQuery, now: Column) -> Column:
    """The conjunction of what is set; a posting without any known pay is kept by a pay range. Columns: status, verdict, level, family, countries, pay, published, updated, first_seen, exempt, valid_through."""
    some = lambda name, values: F.col(name).isin(*values) if values else None
    reference, _ = P.recency_reference(F.col("published"), F.col("updated"), F.col("first_seen"))
    return P.all_of(
        [
            None if q.with_closed else F.col("status") != "CLOSED",
            some("verdict", q.verdicts),
            some("level", q.levels),
            some("family", q.families),
            P.member_or_unknown(F.col("countries"), list(q.countries)) if q.countries else None,
            pay_fits(q) | ~pay_known() if q.salary_min is not None or q.salary_max is not None else None,
            P.recently_visible(reference, F.col("exempt"), F.col("valid_through"), now, q.days) if q.days else None,
        ]
    )


def ordering(q: InboxQuery, accepted: tuple[str, ...]) -> tuple[Column, ...]:
    """Every order is total: it ends with the id. Columns: verdict, level, score, published, rank, id."""
    recent, last = F.col("published").desc_nulls_last(), F.col("id").asc()
    if q.order == "SEARCH":
        return F.col("rank").desc(), recent, last
    if q.order == "RECENCY":
        return recent, last
    if q.order == "SCORE":
        return F.col("score").desc_nulls_last(), recent, last
    known = F.col("level").isin(*accepted) & (F.col("level") != "UNKNOWN") if accepted else F.lit(False)
    first = lambda c: F.when(c, 0).otherwise(1)
    return first(F.col("verdict").isin(*TOP_VERDICTS)), first(known), F.col("score").desc_nulls_last(), recent, last


@dataclass(frozen=True)
class Gate:
    """A check of a rollout: a measure, its bound, and whether it must be at least or at most that."""

    name: str
    bound: float
    at_least: bool = True


def rollout(evidence: dict[str, float | None], gates: tuple[Gate, ...]) -> tuple[bool, list[str]]:
    """(ready, what fails): a measure that is missing fails."""
    failed = [g.name for g in gates if (x := evidence.get(g.name)) is None or (x < g.bound if g.at_least else x > g.bound)]
    return not failed, failed
