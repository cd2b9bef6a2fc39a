"""Many phrases at once: rules as data, one automaton over all of them, evidence instead of verdicts.

A rule says that a phrase stands for a value of a facet. Texts are read as folded words (small letters, no accents, what is
no letter, digit, + or # between them), so a phrase stands only at words' edges; one that ends with * stands where its last
word begins. All rules are one Aho-Corasick automaton, built once a task, so a text costs its length, however many rules
there are. What is found is an array of (facet, value, phrase, first word, times); facets with more than one value are
conflicts, with both named, and never a guess.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.search import folded
from sievelake.session import small_batches

#: Rules that are sent to all tasks at most: some tens of megabytes as an automaton.
MOST_RULES = 200_000
WORDS = re.compile(r"[a-z0-9+#]+")
#: Texts whose evidence a task holds at once at most, and pieces of evidence from which on it is passed on sooner.
SLICE, PIECES = 128, 10_000
EVIDENCE = "array<struct<facet:string,value:string,phrase:string,at:int,times:int>>"


@dataclass(frozen=True)
class Rule:
    facet: str
    value: str
    phrase: str


@dataclass(frozen=True)
class Hit:
    """A rule that stands in a text: at the `at`-th word, `length` words long."""

    rule: Rule
    at: int
    length: int


class Phrases:
    """All rules as one automaton."""

    def __init__(self, rules: tuple[Rule, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_key: dict[str, list[Rule]] = {}
        for r in rules:
            words = WORDS.findall(folded(r.phrase))
            if words:
                by_key.setdefault(" " + " ".join(words) + ("" if r.phrase.endswith("*") else " "), []).append(r)
        for key, same in by_key.items():
            self.automaton.add_word(key, (key.count(" ") - key.endswith(" "), len(key), same))
        self.any = bool(by_key)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> list[Hit]:
        """Every rule at every place, overlapping ones too, in order."""
        if not self.any or not words:
            return []
        text = " " + " ".join(words) + " "
        number, at = {}, 0
        for k, w in enumerate(words):
            number[at] = k
            at += len(w) + 1
        return [Hit(r, number[end + 1 - size], length) for end, (length, size, same) in self.automaton.iter(text) for r in same]

    def longest(self, words: list[str]) -> list[Hit]:
        """Those that no longer one, or one that begins before them, takes their words from."""
        free, out = 0, []
        for h in sorted(self.hits(words), key=lambda h: (h.at, -h.length)):
            if h.at >= free:
                out.append(h)
                free = h.at + h.length
        return out


@functools.lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Phrases:
    return Phrases(rules)


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table (facet, value, phrase), each once; more than can be sent to all tasks are refused, not cut."""
    rows = table.where("facet is not null and value is not null and phrase is not null").select("facet", "value", "phrase").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(sorted((Rule(r.facet, r.value, r.phrase) for r in rows), key=lambda r: (r.facet, r.value, r.phrase)))


def evidence_of(text: str | None, phrases: Phrases) -> list[tuple[str, str, str, int, int]]:
    found: dict[Rule, list[int]] = {}
    for h in phrases.hits(WORDS.findall(folded(text or ""))):
        found.setdefault(h.rule, []).append(h.at)
    return sorted((r.facet, r.value, r.phrase, min(at), len(at)) for r, at in found.items())


def evidence(df: DataFrame, rules: tuple[Rule, ...]) -> object:
    """A function of a text column: what stands in each text, by facet, value and phrase; nothing in a null one."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(rules)  # MOST_RULES at most

    @F.pandas_udf(EVIDENCE)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = compiled(sent.value)
        for texts in batches:
            held, pieces = [], 0
            for text in texts:
                held.append([dict(zip(("facet", "value", "phrase", "at", "times"), e, strict=True)) for e in evidence_of(text, phrases)])
                pieces += len(held[-1])
                if len(held) == SLICE or pieces >= PIECES:
                    yield pd.Series(held, dtype=object)
                    held, pieces = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return found


def verdict(found: Column, facet: str) -> Column:
    """struct<value, conflict> of one facet: its one value; of several none, and their names."""
    values = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda e: e["facet"] == facet), lambda e: e["value"])))
    return F.struct(F.when(F.size(values) == 1, F.get(values, F.lit(0))).alias("value"), F.when(F.size(values) > 1, F.array_join(values, "|")).alias("conflict"))


def measured(found: DataFrame, labels: DataFrame, key: str, right: Column, least: int, share: float) -> DataFrame:
    """(facet, value, phrase, emitted, right_share, passes): how often a rule speaks for labelled rows, how often rightly, and whether it may decide. Rules that speak for none are not listed."""
    said = found.select(key, F.explode("evidence").alias("e")).select(key, "e.facet", "e.value", "e.phrase").join(labels, key)
    counts = said.groupBy("facet", "value", "phrase").agg(F.count(F.lit(1)).alias("emitted"), F.count_if(right).alias("_right"))
    ratio = F.col("_right") / F.col("emitted")
    return counts.select("facet", "value", "phrase", "emitted", F.round(ratio, 6).alias("right_share"), ((F.col("emitted") >= least) & (ratio >= share)).alias("passes"))
