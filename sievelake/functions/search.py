"""Full-text search: a weighted two-language document, web-style queries with synonyms, and rank by cover density.

The stemmer is a plain suffix rule for both languages. A document's fields stand one after the other, with an empty place
between them; a cover is a shortest run of places that has each of the query's concepts. It adds the harmonic mean of its
words' field weights, divided by one more than the places in it that are no concept's. Neither stemmer nor rank is any
database's; both are fixed here, so results do not change with one. `operators/inverted.py` has the same by an index.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the fields A to D, words that are not indexed, endings that are cut, and synonyms.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
STOP = frozenset("a an and as at be by de da do das dos e em for from in is it na no o of on or os para por que the to um uma with".split())
ENDINGS = ("amentos", "amento", "izations", "ization", "acoes", "acao", "ments", "ment", "ings", "ing", "edor", "ers", "er", "oes", "ed", "es", "s")
SYNONYMS = (("developer", "engineer", "programmer", "desenvolvedor"), ("frontend", "front"), ("backend", "back"), ("junior", "jr"), ("senior", "sr"), ("remote", "remoto"))
#: A cover adds whole millionths, so that sums do not depend on their order.
MICRO = 1_000_000


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def stem(word: str) -> str:
    for end in ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if word.endswith("e") and len(word) > 3 else word


def terms(text: str | None) -> list[str]:
    """Stems in order; stop words leave their place empty, so that phrases keep their distances."""
    return ["" if w in STOP else stem(w) for w in re.findall(r"[a-z0-9+#]+", folded(text or ""))]


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and what is left of them without."""
    pairs = [(chr(c), folded(chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, plain) for c, plain in pairs if len(plain) == 1 and plain.isascii()]
    return "".join(c for c, _ in pairs), "".join(plain for _, plain in pairs)


MARKED, PLAIN = _plain_letters()


def tokens(text: Column) -> Column:
    """terms(), by built-in functions: the longest ending that leaves three letters goes, then a last e."""
    words = F.regexp_extract_all(F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", ""), MARKED, PLAIN), F.lit("[a-z0-9+#]+"), F.lit(0))
    cut = lambda w: F.regexp_replace(F.regexp_replace(w, f"^(.{{3,}}?)({'|'.join(ENDINGS)})$", "$1"), "^(.{3,})e$", "$1")
    return F.transform(words, lambda w: F.when(w.isin(*sorted(STOP)), "").otherwise(cut(w)))


def document(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<A, B, C, D> of token arrays."""
    return F.struct(*[tokens(x).alias(n) for n, x in zip("ABCD", (a, b, c, d), strict=True)])


@dataclass(frozen=True)
class Query:
    """Groups that must all match, each by one of its phrases; and phrases that must not."""

    groups: tuple[tuple[tuple[str, ...], ...], ...]
    excluded: tuple[tuple[str, ...], ...]


def variants(word: str) -> list[str]:
    """The word and its synonyms."""
    for group in SYNONYMS:
        if word in group:
            return [word, *(w for w in group if w != word)]
    return [word]


def parse(text: str) -> Query:
    """Web-style: words are ANDed, `or` joins neighbours, quotes make a phrase, a minus excludes."""
    groups: list[list[tuple[str, ...]]] = []
    excluded, joining = [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        low = folded(word)
        if low == "or" and groups:
            joining = True
            continue
        found = tuple(terms(phrase)) if phrase else None
        options = [found] if found else [t for w in (variants(low.strip(".,;:")) if not minus else [low]) if (t := tuple(terms(w)))]
        options = [o for o in options if any(o)]
        if not options:
            continue
        if minus:
            excluded += options
        elif joining:
            groups[-1] += options
        else:
            groups.append(options)
        joining = False
    return Query(tuple(map(tuple, groups)), tuple(excluded))


def has_phrase(field: Column, phrase: tuple[str, ...]) -> Column:
    """The phrase's stems stand one after the other; a stop word's place may hold anything."""
    if len(phrase) == 1:
        return F.array_contains(field, phrase[0])
    return F.exists(F.transform(field, lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(field, i + k) == w, F.lit(False)) for k, w in enumerate(phrase) if w], F.lit(True))), lambda x: x)


def anywhere(doc: Column, phrase: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [has_phrase(doc[f], phrase) for f in WEIGHTS])


def matches(doc: Column, query: Query) -> Column:
    """A query of nothing finds nothing."""
    if not query.groups:
        return F.lit(False)
    found = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [anywhere(doc, p) for p in g]) for g in query.groups])
    return reduce(lambda a, b: a & ~b, [anywhere(doc, p) for p in query.excluded], found)


def places(doc: Column) -> Column:
    """array<struct<term, code>> of a document: 4 * place + number of the field. Stop words have a place, but no entry."""
    parts, start = [], F.lit(0)
    for k, f in enumerate(WEIGHTS):
        parts.append(F.transform(doc[f], lambda w, i: F.struct(w.alias("term"), ((i + start) * 4 + k).cast("int").alias("code"))))
        start = start + F.size(doc[f]) + 1
    return F.filter(F.concat(*parts), lambda x: x["term"] != "")


def starts(codes: Callable[[str], Column], phrase: tuple[str, ...]) -> Column:
    """Codes of the places where a phrase begins, by the codes of each of its words."""
    words = [(k, w) for k, w in enumerate(phrase) if w]
    at, first = words[0]
    here = F.transform(codes(first), lambda c: c - 4 * at)
    for k, w in words[1:]:
        here = F.filter(here, lambda c: F.array_contains(codes(w), c + 4 * k))
    return here


def events(codes: Callable[[str], Column], query: Query) -> list[Column]:
    """For each group of a query, the codes of the places where any of its phrases begins."""
    return [F.array_distinct(F.flatten(F.array(*[starts(codes, p) for p in g]))) for g in query.groups]


def cover_density(groups: list[Column]) -> Column:
    """One sweep over all places in order: a cover ends where the least of the groups' last places has moved on. Of no groups, 0."""
    if not groups:
        return F.lit(0.0)
    n = len(groups)
    each = [F.transform(g, lambda c: F.struct(F.shiftright(c, 2).alias("at"), F.lit(k).alias("g"), (1.0 / F.element_at(F.array(*map(F.lit, WEIGHTS.values())), F.pmod(c, F.lit(4)) + 1)).alias("w"))) for k, g in enumerate(groups)]
    ordered = F.array_sort(F.concat(*each))
    nothing = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.array_repeat(F.lit(0.0), n).alias("w"), F.lit(-1).alias("left"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, e: Column) -> Column:
        put = lambda array, value: F.transform(array, lambda x, i: F.when(i == e["g"], value).otherwise(x))
        last, w = put(state["last"], e["at"]), put(state["w"], e["w"])
        left = F.array_min(last)
        noise = F.greatest(e["at"] - left + 1 - n, F.lit(0))
        score = F.floor(MICRO * (n / F.aggregate(w, F.lit(0.0), lambda a, x: a + x)) / (1.0 + noise))
        new = left > state["left"]
        return F.struct(last.alias("last"), w.alias("w"), F.greatest(left, state["left"]).alias("left"), (state["total"] + F.when(new, score).otherwise(F.lit(0).cast("long"))).alias("total"))

    return F.aggregate(ordered, nothing, step, lambda s: s["total"] / MICRO)


def rank(doc: Column, query: Query) -> Column:
    """Cover density of a document that matches."""
    codes = lambda w: F.transform(F.filter(places(doc), lambda x: x["term"] == w), lambda x: x["code"])
    return cover_density(events(codes, query))
