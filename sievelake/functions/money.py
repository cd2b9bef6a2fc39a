"""Pay in texts and records."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAY = T.StructType([T.StructField("amount_min", T.DecimalType(14, 2)), T.StructField("amount_max", T.DecimalType(14, 2)), T.StructField("currency", T.StringType()), T.StructField("period", T.StringType()), T.StructField("gross_net", T.StringType())])

#: What a currency, a period and a tax basis are called.
CURRENCIES = (("BRL", r"r\$|\bbrl\b|\breais\b"), ("USD", r"us\$|\busd\b|(?<![a-z])\$"), ("EUR", r"€|\beur\b|\beuros?\b"), ("GBP", r"£|\bgbp\b"))
PERIODS = (("HOUR", r"per hour|/ ?h(?:our|r)?\b|hourly|por hora"), ("MONTH", r"per month|/ ?m(?:onth|o)?\b|monthly|por m[eê]s|mensal"), ("YEAR", r"per (?:year|annum)|/ ?y(?:ea)?r\b|yearly|annual|por ano|anual"))
BASES = (("GROSS", r"\bgross\b|\bbruto\b"), ("NET", r"\bnet\b|l[ií]quido"))
BENEFITS = re.compile(r"(?i)bonus|b[oô]nus|vale|voucher|stipend|aux[ií]lio|equity|referral|raised|funding")
AMOUNT = r"(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)\s?(k\b|mil\b)?"
RANGE = re.compile(rf"(?i)(r\$|us\$|\$|€|£)?\s?{AMOUNT}(?:\s?(?:-|–|to|a|até|e)\s?(?:r\$|us\$|\$|€|£)?\s?{AMOUNT})?")


def plain_number(text: Column) -> Column:
    """The number in `1.234,56` and `1,234.56`: the last mark is the decimal one if one or two digits follow it."""
    decimal_comma = text.rlike(r",\d{1,2}$")
    decimal_point = text.rlike(r"\.\d{1,2}$")
    without = F.when(decimal_comma, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(decimal_point, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(text, "[.,]", ""))
    return without.try_cast("decimal(14,2)")


def money_amount(text: Column) -> Column:
    """A number with a `k` or `mil` for thousands."""
    number = plain_number(F.regexp_extract(text, r"([\d.,]*\d)", 1))
    return (number * F.when(F.lower(text).rlike(r"\d\s?(k|mil)\b"), 1000).otherwise(1)).cast("decimal(14,2)")


def unique_name(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The one name whose words are there; null if none is, or several."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in patterns]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def period_from_text(text: Column) -> Column:
    return unique_name(text, PERIODS)


def gross_net_from_text(text: Column) -> Column:
    return unique_name(text, BASES)


def _number(text: str, scale: str | None) -> Decimal:
    if re.search(r",\d{1,2}$", text):
        text = text.replace(".", "").replace(",", ".")
    elif re.search(r"\.\d{1,2}$", text):
        text = text.replace(",", "")
    else:
        text = re.sub(r"[.,]", "", text)
    return Decimal(text) * (1000 if scale else 1)


def _only(text: str, patterns) -> str | None:
    found = [n for n, p in patterns if re.search(p, text)]
    return found[0] if len(found) == 1 else None


def pay_in_text(text: str | None) -> dict | None:
    """The first amount with a currency beside it, unless it is a benefit; a scale on one side of a range holds for both."""
    for m in RANGE.finditer(text or ""):
        window = text[max(0, m.start() - 30) : m.end() + 30].lower()
        currency = _only(text[max(0, m.start() - 6) : m.end() + 8].lower(), CURRENCIES[:1]) or _only(text[max(0, m.start() - 6) : m.end() + 8].lower(), CURRENCIES[1:])
        if currency is None or BENEFITS.search(window):
            continue
        scale = m[3] or m[5]
        low = _number(m[2], scale)
        high = _number(m[4], m[5]) if m[4] else low
        if low > high or high < 5:
            continue
        return {"amount_min": low, "amount_max": high, "currency": currency, "period": _only(window, PERIODS), "gross_net": _only(window, BASES)}
    return None


@F.pandas_udf(PAY)
def text_compensation(texts: pd.Series) -> pd.DataFrame:
    names = ["amount_min", "amount_max", "currency", "period", "gross_net"]
    return pd.DataFrame([pay_in_text(t) or dict.fromkeys(names) for t in texts], columns=names).astype(object)


def structured_compensation(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """From a record's own fields; null unless there is an amount and a currency."""
    amount = lambda c: c.try_cast("decimal(14,2)")
    known = currency.isNotNull() & (amount(low).isNotNull() | amount(high).isNotNull())
    return F.when(known, F.struct(amount(low).alias("amount_min"), amount(high).alias("amount_max"), F.upper(currency).alias("currency"), F.upper(period).alias("period"), F.lit(None).cast("string").alias("gross_net")))


def compensation(structured: Column, parts: Column, summary: Column, description: Column) -> Column:
    """The most reliable of what is known: the record's range, its parts, its own summary, then the description."""
    known = lambda s: F.when(s["currency"].isNotNull(), s)
    return F.coalesce(structured, parts, known(text_compensation(summary)), known(text_compensation(description)))
