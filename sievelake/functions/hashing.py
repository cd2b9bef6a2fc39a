"""Fingerprints and canonical hashes."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
#: Fields that change from one fetch to the next without meaning anything.
VOLATILE = frozenset(("fetched_at", "updated_at", "request_id", "etag", "tracking", "impressions"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts; a missing part is empty, so places keep their meaning."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def posting_group_key(company_id: Column, company_name: Column, title: Column, first_source: Column, posting_id: Column) -> Column:
    """Company, title and source, with fallbacks for what is missing."""
    company = F.coalesce(company_id.cast("string"), F.concat(F.lit("name:"), F.lower(F.coalesce(company_name, F.lit("")))))
    return F.concat_ws("|", company, title, F.coalesce(first_source.cast("string"), F.concat(F.lit("id:"), posting_id.cast("string"))))


def canonical_json(value) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def settled(value, dropped: frozenset[str] = VOLATILE):
    """Without volatile fields, and with every run of space as one."""
    if isinstance(value, dict):
        return {k: settled(v, dropped) for k, v in value.items() if k not in dropped}
    if isinstance(value, list):
        return [settled(v, dropped) for v in value]
    return re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else value


def _hashed(texts: pd.Series, of) -> pd.Series:
    out = []
    for t in texts:
        try:
            out.append(None if t is None else hashlib.sha256(canonical_json(of(json.loads(t))).encode()).hexdigest())
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def payload_hash(payloads: pd.Series) -> pd.Series:
    """Of a JSON payload, whatever the order of its fields; null if it is no JSON."""
    return _hashed(payloads, lambda x: x)


@F.pandas_udf(T.StringType())
def semantic_hash(payloads: pd.Series) -> pd.Series:
    """Of what a payload means: a change of spacing or of volatile fields does not change it."""
    return _hashed(payloads, settled)


def scope_hash(filters: Column) -> Column:
    """Of an array of filters, whatever their order and case."""
    return F.sha2(F.to_json(F.array_sort(F.transform(filters, F.lower))), 256)
