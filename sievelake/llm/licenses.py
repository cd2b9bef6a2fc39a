"""License scans by a positional rare-token index.

Templates are whole texts of short public licences, and notices of long ones. How many documents each template word
occurs in is counted over the whole corpus (a table no larger than the templates' vocabulary); a template is indexed
under its words of highest inverse document frequency, its anchors, and with each the places where it stands. A file's
licence words of highest inverse document frequency are looked up first: as a match needs a share of the anchors, it has
one of the rarest few, and only templates that one of these opens are looked for by the file's other words. A word at p
that the template has at i stands for a template that starts at p - i, and postings are thus intersected by relative
position: a start is a candidate if enough different anchors stand for it
or for one of the starts after it that `shift` inserted words make. Each anchor counts once, however often it is
repeated. A candidate counts only if one of the template's mandatory key phrases stands at its own place, within the
same shift, word for word.

The three base phrases are templates whose every word must stand at its place, so none is ever missed; so are names of
licences with their versions, and their identifiers after `SPDX-License-Identifier`. As frequencies are the corpus's own, so
is the choice of anchors: another corpus may tell a text of few of a template's words differently; names and base phrases
are told alike in all.

Null text is empty: no words, no labels, score 0. Repeated rows give repeated rows; an empty table gives none. Words of
equal frequency are taken in order of the alphabet; of a label's matches the best gives the score. A very long text is
one list of words, with two numbers for each that is an anchor. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import counted
from sievelake.llm.licence_texts import NAMES, TEXTS

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of a template that it is indexed under, and the share of them that must stand for one start.
ANCHORS, SHARE = 12, 0.6
#: Words that may have been inserted before a word: so many, or one in so many of the template's.
SHIFT, SHIFT_SHARE = 4, 25


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  #: one must stand in the match, word for word, at its place
    base: bool = False  #: every word must stand at its place
    name: bool = False  #: so must those of a licence's name or identifier

    @property
    def whole(self) -> bool:
        return self.base or self.name


#: The base phrases; then the licences.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    *(Template(*x) for x in TEXTS),
    *(Template(label, name, name=True) for label, names in NAMES for name in names),
)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(UPPER))


def places_of(phrase: list[str], words: list[str]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


class Index:
    """Template postings of rare words: word -> [(template, place in it)]."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], n_docs: int):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        #: (place, words) of each mandatory phrase
        self.keys = [[(i, k.split()) for k in t.keys for i in places_of(k.split(), ws)] for t, ws in zip(templates, self.words, strict=True)]
        if lost := [t.label for t, keys in zip(templates, self.keys, strict=True) if not keys and not t.whole]:
            raise ValueError(f"templates without their key phrases: {lost}")
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1e-3 for ws in self.words for w in ws}
        self.shift = [max(SHIFT, len(ws) // SHIFT_SHARE) for ws in self.words]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.openers: dict[str, list[int]] = defaultdict(list)
        self.anchors, self.need = [], []
        for k, ws in enumerate(self.words):
            rare = sorted(set(ws), key=lambda w: (-self.idf[w], w))
            rare = rare if templates[k].whole else rare[:ANCHORS]
            self.anchors.append(frozenset(rare))
            for i, w in enumerate(ws):
                if w in self.anchors[k]:
                    self.postings[w].append((k, i))
            self.need.append(len(ws) if templates[k].whole else max(2, math.ceil(SHARE * len(rare))))
            # a file with so many of the anchors has one of these, the rarest
            for w in rare[:1] if templates[k].whole else rare[: len(rare) - self.need[k] + 1]:
                self.openers[w].append(k)
        self.vocabulary = frozenset(self.postings)
        # a file without the rarest word of any base phrase or key phrase has none of them
        self.telling = frozenset(max(p, key=lambda w: (self.idf[w], w)) for k, t in enumerate(templates) for p in ([self.words[k]] if t.whole else [key for _, key in self.keys[k]]))

    def candidates(self, k: int, hits: list[tuple[int, str]]) -> Iterator[int]:
        """Starts from which on, within the shift, enough different anchors have hits (start, word)."""
        hits = sorted(hits)
        seen: Counter = Counter()
        end = 0
        for at, (start, word) in enumerate(hits):
            while end < len(hits) and hits[end][0] <= start + self.shift[k]:
                seen[hits[end][1]] += 1
                end += 1
            if len(seen) >= self.need[k] and (at == 0 or hits[at - 1][0] != start):
                yield start
            seen[word] -= 1
            if not seen[word]:
                del seen[word]

    def score(self, k: int, start: int, words: list[str]) -> float:
        """The share, by inverse frequency, of the template's words that stand in the match; 0 without a key phrase at its place."""
        shift = self.shift[k]
        if not any(words[p : p + len(key)] == key for i, key in self.keys[k] for p in range(max(0, start + i), start + i + shift + 1)):
            return 0.0
        own = set(self.words[k])
        window = words[max(0, start) : max(0, start + len(self.words[k]) + shift)]
        return min(1.0, sum(self.idf[w] for w in own.intersection(window)) / sum(self.idf[w] for w in own))

    def match(self, words: list[str]) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """(label, start) of every base phrase, and the best score of each label."""
        if self.telling.isdisjoint(words):
            return [], {}
        # the file's rarest licence words open templates; the others are looked up for these alone
        opened: set[int] = set()
        for word in sorted(self.openers.keys() & set(words), key=lambda w: -self.idf[w]):
            opened.update(self.openers[word])
        wanted = {w: [p for p in self.postings[w] if p[0] in opened] for w in self.vocabulary.intersection(words)} if opened else {}
        hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for at, word in enumerate(words):
            for k, i in wanted.get(word, ()):
                hits[k].append((at - i, word))
        base, labels = [], {}
        for k, found in hits.items():
            label = self.templates[k].label
            if self.templates[k].whole:
                starts = [s for s, n in Counter(s for s, _ in found).items() if n == self.need[k]]
                base += [(label, s) for s in starts if self.templates[k].base]
                best = 1.0 if starts else 0.0
            else:
                best = max((self.score(k, s, words) for s in self.candidates(k, found)), default=0.0)
            if best:
                labels[label] = max(labels.get(label, 0.0), best)
        return sorted(base, key=lambda x: (x[1], x[0])), labels


def frequencies(rows: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, and the number of documents. One row for each template word comes to the driver."""
    wanted = frozenset(w for t in templates for w in words_of(t.text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            found[""] += len(batch)
            for text in batch["text"]:
                found.update(wanted.intersection(words_of(text)))
        yield from counted(found, "word")

    found = {r["word"]: r["n"] for r in rows.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, base: places of base phrases, labels: with scores) of every whole text."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts, n_docs = frequencies(rows, templates)
    index = Index(templates, counts, n_docs)

    @F.pandas_udf("n_words long, base array<struct<label:string,start:long>>, labels array<struct<label:string,score:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            base, labels = index.match(words)
            out.append((len(words), [{"label": b, "start": s} for b, s in base], [{"label": x, "score": y} for x, y in sorted(labels.items())]))
        return pd.DataFrame(out, columns=["n_words", "base", "labels"])

    return rows.select(F.col("id").alias(id_col), run("text").alias("f")).select(id_col, "f.*")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).alias("first_word"),
        F.array_max(F.col("base")["start"]).alias("last_word"),
        names(F.col("base")["label"]).alias("base_labels"),
        names(F.col("labels")["label"]).alias("labels"),
        F.coalesce(F.array_max(F.col("labels")["score"]), F.lit(0.0)).alias("score"),
    )
