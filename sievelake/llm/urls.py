"""URL filters: pattern rules indexed by their rarest literal token.

Rules are of two sorts. A listed rule has a host (it fits the host and all subdomains) and a path prefix. The method's own
are lines of the public format of content blockers: `||` stands for the start of a label of the host, `|` for the start or
the end, `^` for a separator or the end, `*` for anything, and `@@` before a rule makes it an exception. Each line is
compiled to a regular expression over host and path, and has literal tokens, those that any URL it fits holds whole.

How often each rule token occurs in all URLs is counted first (a table no larger than the rules); each rule is then filed
under its rarest. A URL's tokens fetch candidate rules, and only those are compared or run as regular expressions: of
about 2,000 rules, a URL tries one or two. Of the listed rules that fit, the longest wins; if none fits, an exception
that fits allows the URL, else any other of the method's rules that fits blocks it, the first in order being named; and if
none does, the URL is allowed.

A null URL, or one without `://`, has an empty host and path, no rule, and is allowed. Repeated rows give repeated
rows; an empty table gives none. Ties of listed rules of one length go to the first, tokens of equal frequency in order of
the alphabet. A very long URL is read whole. Only the id and URL columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import counted

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str = ""
    path: str = ""
    line: str = ""  #: of the public format, without `@@`

    @property
    def name(self) -> str:
        return self.line or f"{self.host}{self.path}"

    def tokens(self) -> list[str]:
        if self.line:
            return literal_tokens(self.line)
        whole = self.path.rpartition("/")[0] if not self.path.endswith("/") else self.path
        return [*TOKEN.findall(self.host), *TOKEN.findall(whole.translate(UPPER))]


def pattern_of(line: str) -> str:
    """The regular expression, over lower-cased host and path, of a line."""
    body, start = (line[2:], r"^(?:[^/]*[.])?") if line.startswith("||") else (line[1:], "^") if line.startswith("|") else (line, "")
    body, end = (body[:-1], "$") if body.endswith("|") else (body, "")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    return start + "".join(parts.get(c) or (c if c.isalnum() else f"[{c}]") for c in body) + end


def literal_tokens(line: str) -> list[str]:
    """Runs of letters and digits that both ends of which the line tells."""
    body = line.strip("|")
    known = line.startswith("|"), line.endswith("|")
    return [m.group() for m in TOKEN.finditer(body) if (m.start() > 0 or known[0]) and (m.end() < len(body) or known[1]) and "*" not in (body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1])]


def parsed(line: str) -> Rule:
    return Rule("allow", line=line[2:]) if line.startswith("@@") else Rule("block", line=line)


#: The listed rules.
LISTED = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


#: What no crawl wants: (subjects, what they are coupled with in names). A word alone is no reason to block.
TOPICS = (
    ("casino poker bets betting slots jackpot lottery roulette bingo", "win wins free online best bonus club live vip play money now"),
    ("adult porn xxx sex escort nude cams", "x free hot live cam girls club video tube chat"),
    ("pills viagra cialis pharmacy meds", "cheap buy online discount generic order best"),
    ("ads ad adserver banner popup", "track tracker tracking click count serve pixel sync"),
    ("spam phishing malware warez torrent crack keygen", "farm free download downloads link links site hub"),
)
#: The places of a couple: a host's label, with a hyphen or without, and a path's segment.
FORMS = ("||{a}-{b}.", "||{b}-{a}.", "||{a}{b}.", "||{b}{a}.", "/{a}-{b}^", "/{b}-{a}^")
#: Hosts that write about such things.
EXCEPTIONS = ("@@||edu^", "@@||gov^", "@@||wikipedia.org^", "@@||who.int^", "@@/news/*^prevention^")
OWN = tuple(parsed(x) for x in (*EXCEPTIONS, *(f.format(a=a, b=b) for subjects, coupled in TOPICS for a in subjects.split() for b in coupled.split() for f in FORMS)))


def parts(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER), slash + path


def tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host)) | set(TOKEN.findall(path.translate(UPPER)))


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token; those that have none stand under the empty token, which every URL fetches."""
    found: dict[str, list[int]] = defaultdict(list)
    for k, rule in enumerate(rules):
        found[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(k)
    return dict(found)


class Judge:
    """Rules compiled and filed."""

    def __init__(self, listed: tuple[Rule, ...], own: tuple[Rule, ...], counts: dict[str, int]):
        self.rules, self.n_listed = listed + own, len(listed)
        self.by_token = index(self.rules, counts)
        self.patterns = [re.compile(pattern_of(r.line)) if r.line else None for r in self.rules]

    def fits(self, k: int, host: str, path: str, both: str) -> bool:
        rule, pattern = self.rules[k], self.patterns[k]
        if pattern:
            return pattern.search(both) is not None
        return (host == rule.host or host.endswith(f".{rule.host}")) and path.startswith(rule.path)

    def __call__(self, host: str, path: str) -> tuple[str | None, str, str | None, int]:
        """(rule, verdict, pattern, tried): the longest listed rule, else the method's own first exception, else its first rule in order; and how many rules were tried."""
        candidates = sorted({k for t in (*tokens(host, path), "") for k in self.by_token.get(t, ())}) if host or path else []
        both = host + path.translate(UPPER)
        good = [k for k in candidates if self.fits(k, host, path, both)]
        best = max((k for k in good if k < self.n_listed), key=lambda k: (len(self.rules[k].name), -k), default=None)
        if best is not None:
            return self.rules[best].name, self.rules[best].verdict, None, len(candidates)
        own = min((k for k in good if k >= self.n_listed), key=lambda k: (self.rules[k].verdict == "block", k), default=None)
        return (None, "allow", None, len(candidates)) if own is None else (None, self.rules[own].verdict, self.rules[own].line, len(candidates))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", listed: tuple[Rule, ...] = LISTED, own: tuple[Rule, ...] = OWN, tried: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of every URL; with `tried`, also how many rules were."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    wanted = {t for r in listed + own for t in r.tokens()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for url in batch["url"]:
                found.update(tokens(*parts(url)) & wanted)
        yield from counted(found, "token")

    counts = {r["token"]: r["n"] for r in rows.select("url").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(listed, own, counts)
        for batch in batches:
            found = [(*of, *judge(*of)) for of in map(parts, batch["url"])]
            out = pd.DataFrame(found, columns=["host", "path", "rule", "verdict", "pattern", "tried"])
            out.insert(0, "id", batch["id"].array)
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, host string, path string, rule string, verdict string, pattern string, tried long").withColumnRenamed("id", id_col)
    return out if tried else out.drop("tried")
