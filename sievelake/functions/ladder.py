"""Levels of job titles by a table of wordings, each with how surely it tells the level.

The wordings of the lowest tier that a title has decide: what names a level comes before what implies one. Of overlapping
wordings the longest counts, so a craft that holds a level's word (an account manager) hides it. Levels that stand as
alternatives (`Mid or Senior`, `II/III`) are one choice, which is as low as its lowest; else the highest level counts,
but for programmes of learners, which come before all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.phrases import Phrases, Rule
from sievelake.functions.search import folded

UNKNOWN = "UNKNOWN"
#: Levels from low to high.
LEVELS = ("INTERN", "JUNIOR", "MID", "SENIOR", "STAFF", "LEAD", "MANAGER", "DIRECTOR")
#: Levels of single contributors, which a posting may offer as a choice.
CHOICES = LEVELS[1:5]
NAMED, ENTRY, NUMERAL, IMPLIED = range(4)

#: What a level is called, by tier.
WORDINGS = (
    (NAMED, "INTERN", "intern, interns, internship, internships, working student, trainee, trainees, apprentice, apprentices, apprenticeship, estagio, estagios, estagiario, estagiaria, estagiarios, aprendiz"),
    (NAMED, "JUNIOR", "junior, juniors, jr, entry level, early career, graduate, new graduate, new grad, recem formado"),
    (NAMED, "MID", "mid, mid level, mid career, middle, intermediate, intermediario, intermediaria, semi senior, pl, pleno, plena, plenos"),
    (NAMED, "SENIOR", "senior, seniors, sr, sra, experienced"),
    (NAMED, "STAFF", "staff, principal, distinguished, especialista"),
    (NAMED, "LEAD", "lead, leads, lider, tech lead, team lead, team leader, lider tecnico"),
    (NAMED, "MANAGER", "manager, managers, gerente, gerentes"),
    (NAMED, "DIRECTOR", "director, diretor, diretora, head, head of, vp, vice president, vice presidente"),
    (ENTRY, "JUNIOR", "associate"),
    (NUMERAL, "JUNIOR", "i"),
    (NUMERAL, "MID", "ii"),
    (NUMERAL, "SENIOR", "iii"),
    (IMPLIED, "SENIOR", "architect, arquiteto, arquiteta"),
)
#: Crafts, places, units and studies, as a noun before or after a word that would be a level alone.
CRAFTS = {
    "manager": "account, brand, campaign, case, category, community, event, facilities, inventory, office, portfolio, product, program, project, property, release",
    "gerente": "",
}
OTHER = ("chief of staff", "technical staff", "staff member", "middle east", "middle market", "middle school", "middle office", "pl sql", "graduate school", "graduate degree", "graduate studies", "graduate program", "data labeling associate", "data labelling associate", "lead generation", "head office", "head hunter")
CONNECTING = frozenset("a ate and e or ou through to".split())
BETWEEN = re.compile(r"[\s/,|&().–—-]*")
MARK = re.compile(r"[/,|&–—-]")
WORD = re.compile(r"[a-z0-9+#]+")


def _rules() -> tuple[Rule, ...]:
    named = [Rule(str(tier), level, w.strip()) for tier, level, words in WORDINGS for w in words.split(",")]
    crafts = [Rule("", "", f"{noun.strip()} {word}") for word, nouns in CRAFTS.items() for noun in nouns.split(",") if noun]
    return tuple(named + crafts + [Rule("", "", w) for w in OTHER])


_PHRASES: list[Phrases] = []


def _phrases() -> Phrases:
    if not _PHRASES:
        _PHRASES.append(Phrases(_rules()))
    return _PHRASES[0]


def named_levels(title: str) -> tuple[int, list[tuple[int, int, str]], list[re.Match], str]:
    """(tier, [(first word, word after, level)] of that tier, the title's words, the title folded)."""
    low = folded(title)
    words = list(WORD.finditer(low))
    found = [h for h in _phrases().longest([w.group() for w in words]) if h.rule.value]
    # a numeral is written in capitals
    capital = [w.group() for w in re.finditer(r"\b[IVX]+\b", title)]
    found = [h for h in found if h.rule.facet != str(NUMERAL) or words[h.at].group().upper() in capital]
    tier = min((int(h.rule.facet) for h in found), default=-1)
    return tier, [(h.at, h.at + h.length, h.rule.value) for h in found if h.rule.facet == str(tier)], words, low


def is_choice(before: tuple[int, int, str], after: tuple[int, int, str], words: list[re.Match], low: str) -> bool:
    """Whether only connecting words and signs, and some of them, stand between two levels."""
    between = [w.group() for w in words[before[1] : after[0]]]
    span = low[words[before[1] - 1].end() : words[after[0]].start()]
    signs = WORD.sub("", span)
    return all(w in CONNECTING for w in between) and bool(BETWEEN.fullmatch(signs)) and bool(between or MARK.search(signs))


def level_of(title: str | None) -> str:
    tier, found, words, low = named_levels(title or "")
    if not found:
        return UNKNOWN
    levels = [level for *_, level in found]
    if LEVELS[0] in levels:
        return LEVELS[0]
    chains: list[list[str]] = []
    for k, f in enumerate(found):
        joined = k and f[2] in CHOICES and found[k - 1][2] in CHOICES and is_choice(found[k - 1], f, words, low)
        if joined:
            chains[-1].append(f[2])
        else:
            chains.append([f[2]])
    offered = [x for c in chains if len(set(c)) > 1 for x in c]
    highest = max(levels, key=LEVELS.index)
    return min(offered, key=LEVELS.index) if offered and highest in CHOICES else highest


@F.pandas_udf(T.StringType())
def seniority(titles: pd.Series) -> pd.Series:
    return pd.Series([level_of(t) for t in titles], dtype=object)
