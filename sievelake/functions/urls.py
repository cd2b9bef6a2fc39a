"""URLs: canonical forms, hosts, boards and keys."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query fields that tell nothing about the page.
TRACKING = re.compile(r"^(utm_.*|ref|source)$")


def canonical(url: str | None, web_only: bool = True) -> str | None:
    """Lower-case host, sorted query without tracking fields, no fragment, no trailing slash."""
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    if web_only and parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        return None
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    host = parts.hostname.lower() + (f":{port}" if port and port != default else "")
    query = urlencode(sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not TRACKING.match(k.lower())))
    return urlunsplit((parts.scheme.lower(), host, parts.path.rstrip("/") or "/", query, ""))


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return pd.Series([canonical(u) for u in urls], dtype=object)


@F.pandas_udf(T.StringType())
def canonicalize_url(urls: pd.Series) -> pd.Series:
    """The same for any scheme."""
    return pd.Series([canonical(u, False) for u in urls], dtype=object)


def ascii_domain(value: str | None) -> str | None:
    if not value or not value.strip():
        return None
    host = urlsplit(value if "://" in value else f"//{value.strip()}").hostname
    if not host:
        return None
    host = host.lower().removeprefix("www.").rstrip(".")
    try:
        return host.encode("idna").decode()
    except UnicodeError:
        return None


@F.pandas_udf(T.StringType())
def normalize_domain(values: pd.Series) -> pd.Series:
    return pd.Series([ascii_domain(v) for v in values], dtype=object)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def matches_rule(url: Column, suffix: str, prefix: str = "/") -> Column:
    """The host is the suffix or a subdomain of it, and the path begins with the prefix."""
    return ((host(url) == suffix) | host(url).endswith(f".{suffix}")) & F.when(path(url) == "", "/").otherwise(path(url)).startswith(prefix)


#: Public job boards, by the pattern of their addresses; the first group is the board's key.
BOARDS = (
    ("greenhouse", r"^https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([A-Za-z0-9_-]+)"),
    ("lever", r"^https?://jobs(?:\.eu)?\.lever\.co/([A-Za-z0-9_-]+)"),
    ("ashby", r"^https?://jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)"),
    ("workable", r"^https?://apply\.workable\.com/([A-Za-z0-9_-]+)"),
    ("teamtailor", r"^https?://([A-Za-z0-9-]+)\.teamtailor\.com"),
    ("workday", r"^https?://([A-Za-z0-9-]+)\.wd\d+\.myworkdayjobs\.com"),
)


def detect_board(url: Column) -> Column:
    """struct<kind, key>, or null."""
    found = F.lit(None)
    for kind, pattern in reversed(BOARDS):
        key = F.regexp_extract(url, pattern, 1)
        found = F.when(key != "", F.struct(F.lit(kind).alias("kind"), key.alias("key"))).otherwise(found)
    return found


def is_public(value: str | None) -> bool:
    """Whether a destination may be fetched: http or https to a public address or a dotted name."""
    try:
        parts = urlsplit(value or "")
        name = parts.hostname
        if parts.scheme not in ("http", "https") or not name or parts.username:
            return False
        try:
            return ipaddress.ip_address(name).is_global
        except ValueError:
            return "." in name and not name.endswith((".local", ".internal", ".localhost"))
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def is_public_destination(values: pd.Series) -> pd.Series:
    return pd.Series([is_public(v) for v in values])


def identity_key(external_id: Column, url: Column, payload_hash: Column) -> Column:
    """By the source's own id, else by address, else by content."""
    return F.coalesce(F.concat(F.lit("external:"), F.nullif(external_id, F.lit(""))), F.concat(F.lit("url:"), F.nullif(url, F.lit(""))), F.concat(F.lit("payload:"), payload_hash))


def robots_rules(text: str, agent: str) -> list[str]:
    """Forbidden path prefixes for an agent: of its own group, else of the group for all."""
    groups: dict[str, list[str]] = {}
    names, rules_begun = [], False
    for line in text.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if rules_begun:
                names, rules_begun = [], False
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            rules_begun = True
            if field == "disallow" and value:
                for name in names:
                    groups[name].append(value)
    own = next((n for n in groups if n != "*" and n in agent.lower()), "*")
    return groups.get(own, [])


def allowed_by_robots(path_column: Column, rules: list[str]) -> Column:
    found = F.lit(True)
    for rule in rules:
        found = found & ~path_column.startswith(rule)
    return found
