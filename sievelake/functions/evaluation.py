"""Measures of generated summaries against their source."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.search import MARKED, PLAIN

PORTUGUESE = frozenset("a ao as com como da das de do dos e em mais na nas no nos nao o os ou para por que se sem sua um uma vaga".split())


def words(text: str | None) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[a-z0-9+#]+", folded)


def covered(expected: list[str], text: str | None) -> float | None:
    """The share of expected phrases all of whose words stand in a text; none if nothing is expected."""
    if not expected:
        return None
    have = set(words(text))
    return sum(set(words(e)) <= have for e in expected) / len(expected)


def invented(claims: list[str], source: str | None) -> list[str]:
    """Claims with a number or name that the source has not."""
    have = set(words(source))
    return [c for c in claims if any(w not in have and (w.isdigit() or len(w) > 3) for w in words(c))]


def portuguese_share(text: str | None) -> float | None:
    found = words(text)
    return sum(w in PORTUGUESE for w in found) / len(found) if found else None


def said_words(text: Column) -> Column:
    """words(), by built-in functions."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", ""), MARKED, PLAIN)
    return F.regexp_extract_all(plain, F.lit("[a-z0-9+#]+"), F.lit(0))


def _lacking(claim: Column, have: Column) -> Column:
    return F.array_except(said_words(claim), have)


def _of_claims(claims: Column, source: Column, counts: Callable[[Column], Column]) -> Column:
    """The share of claims for which something holds of the words that the source lacks; none without a claim."""
    n = F.transform(F.array(said_words(source)), lambda have: F.size(F.filter(claims, lambda c: counts(_lacking(c, have)))))[0]
    return F.when(F.size(claims) > 0, n / F.size(claims))


def coverage(expected: Column, text: Column) -> Column:
    """covered(), by built-in functions."""
    return _of_claims(expected, text, lambda lacking: F.size(lacking) == 0)


def telling(words: Column) -> Column:
    """Those that make a claim an invention: numbers, and words of more than three letters."""
    return F.filter(words, lambda w: w.rlike("^[0-9]+$") | (F.length(w) > 3))


def inventions(claims: Column, source: Column) -> Column:
    """invented(), by built-in functions."""
    return F.transform(F.array(said_words(source)), lambda have: F.filter(claims, lambda c: F.size(telling(_lacking(c, have))) > 0))[0]


def fidelity(claims: Column, source: Column) -> Column:
    """The share of claims that the source bears out; none without a claim."""
    return 1 - _of_claims(claims, source, lambda lacking: F.size(telling(lacking)) > 0)


def language_share(text: Column) -> Column:
    """portuguese_share(), by built-in functions."""
    return F.transform(F.array(said_words(text)), lambda ws: F.try_divide(F.size(F.filter(ws, lambda w: w.isin(*sorted(PORTUGUESE)))), F.size(ws)))[0]
