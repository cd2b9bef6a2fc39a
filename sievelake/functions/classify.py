"""Classifiers of titles, places and descriptions. Rules are data; conflicting evidence is UNKNOWN, never a winner."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.ladder import UNKNOWN, level_of, seniority  # noqa: F401
from sievelake.functions.phrases import WORDS, Phrases, Rule as Phrase
from sievelake.functions.predicates import infer_unique
from sievelake.functions.search import folded

#: How each work mode, contract and level is written.
WORK_MODES = {"REMOTE": r"\bremot[eoa]\b|\bwork from home\b|\bhome office\b|\banywhere\b", "HYBRID": r"\bh[iy]br?[ií]d[oa]?\b|\bhybrid\b", "ONSITE": r"\bon-?site\b|\bin[- ]office\b|\bpresencial\b"}
CONTRACTS = {"CLT": r"\bclt\b", "PJ": r"\bpj\b|\bpessoa jur[ií]dica\b", "CONTRACTOR": r"\bcontractor\b|\bfreelancer?\b", "FULL_TIME": r"\bfull[- ]time\b|\btempo integral\b", "PART_TIME": r"\bpart[- ]time\b|\bmeio per[ií]odo\b", "INTERNSHIP": r"\bintern(?:ship)?\b|\best[aá]gio\b"}
PROGRAMS = r"\bintern(ship)?s?\b|\best[aá]gi(o|ari[oa])\b|\btrainee\b|\bapprentice(ship)?\b|\bjovem aprendiz\b|\bgraduate program"
#: Families by words of the title, the more specific first; then by department; then by what the text says. A last word with * may go on.
FAMILIES = (
    ("DATA_ENGINEERING", "data engineer*, analytics engineer*, engenheiro de dados, engenheira de dados, engenharia de dados, big data, etl"), ("DATA_SCIENCE", "data scien*, machine learning, ml engineer*, cientista de dados, research scientist"), ("DATA_ANALYSIS", "data analy*, bi analy*, analista de dados, business intelligence"),
    ("SECURITY", "security, seguranca, appsec"), ("DEVOPS", "devops, sre, site reliability, platform engineer*, cloud engineer*, infra*"), ("QA", "qa, quality assurance, test engineer*, sdet"),
    ("MOBILE", "android, ios, mobile, flutter, react native"), ("FRONTEND", "frontend, front end, ui engineer*"), ("BACKEND", "backend, back end, api engineer*"), ("FULLSTACK", "fullstack, full stack"),
    ("PRODUCT", "product manager, product owner, gerente de produto"), ("DESIGN", "designer, ux"), ("SOFTWARE", "software, developer, desenvolvedor*, programmer, programador*"),
    ("SALES", "sales, vendas, account executive"), ("MARKETING", "marketing, growth"), ("SUPPORT", "support, suporte, customer success"), ("PEOPLE", "recruit*, human resources, people"), ("FINANCE", "financ*, accountant, accounting, contabil*"),
)
TARGETS = frozenset(name for name, _ in FAMILIES[:13])

#: Countries by their names, and what regions hold.
COUNTRIES = {"brazil": "BR", "brasil": "BR", "united states": "US", "usa": "US", "u.s.": "US", "us": "US", "canada": "CA", "mexico": "MX", "méxico": "MX", "argentina": "AR", "chile": "CL", "colombia": "CO", "portugal": "PT", "spain": "ES", "germany": "DE", "france": "FR", "united kingdom": "GB", "uk": "GB", "ireland": "IE", "india": "IN", "poland": "PL", "netherlands": "NL",
    "peru": "PE", "uruguay": "UY", "paraguay": "PY", "bolivia": "BO", "ecuador": "EC", "venezuela": "VE", "costa rica": "CR", "panama": "PA", "guatemala": "GT", "dominican republic": "DO", "italy": "IT", "switzerland": "CH", "austria": "AT", "belgium": "BE", "luxembourg": "LU", "denmark": "DK", "sweden": "SE", "norway": "NO", "finland": "FI", "iceland": "IS", "estonia": "EE", "latvia": "LV", "lithuania": "LT",
    "czech republic": "CZ", "czechia": "CZ", "slovakia": "SK", "hungary": "HU", "romania": "RO", "bulgaria": "BG", "greece": "GR", "croatia": "HR", "serbia": "RS", "ukraine": "UA", "turkey": "TR", "israel": "IL", "egypt": "EG", "south africa": "ZA", "nigeria": "NG", "kenya": "KE", "united arab emirates": "AE", "uae": "AE", "saudi arabia": "SA", "pakistan": "PK", "bangladesh": "BD", "sri lanka": "LK",
    "china": "CN", "hong kong": "HK", "taiwan": "TW", "japan": "JP", "south korea": "KR", "singapore": "SG", "malaysia": "MY", "indonesia": "ID", "philippines": "PH", "thailand": "TH", "vietnam": "VN", "australia": "AU", "new zealand": "NZ"}
REGIONS = {"latam": ("AR", "BR", "CL", "CO", "MX"), "latin america": ("AR", "BR", "CL", "CO", "MX"), "south america": ("AR", "BR", "CL", "CO"), "north america": ("CA", "MX", "US"), "europe": ("DE", "ES", "FR", "GB", "IE", "NL", "PL", "PT"), "americas": ("AR", "BR", "CA", "CL", "CO", "MX", "US")}
WORLD = re.compile(r"(?i)\b(worldwide|anywhere|global(?:ly)?)\b")

#: Skills by what else they are called.
SKILLS = {
    "python": ("python",), "java": ("java",), "javascript": ("javascript", "js"), "typescript": ("typescript",), "go": ("golang", "go"), "c#": ("c#",), "c++": ("c++",), "rust": ("rust",), "scala": ("scala",), "kotlin": ("kotlin",), "swift": ("swift",), "ruby": ("ruby", "ruby on rails", "rails"), "php": ("php", "laravel"), "elixir": ("elixir",), "r": ("r",), "sql": ("sql",), "bash": ("bash", "shell script"),
    "spark": ("spark", "pyspark", "apache spark"), "hadoop": ("hadoop",), "flink": ("flink",), "airflow": ("airflow",), "kafka": ("kafka",), "dbt": ("dbt",), "snowflake": ("snowflake",), "databricks": ("databricks",), "bigquery": ("bigquery",), "redshift": ("redshift",), "looker": ("looker",), "power bi": ("power bi", "powerbi"), "tableau": ("tableau",), "pandas": ("pandas",), "numpy": ("numpy",),
    "pytorch": ("pytorch",), "tensorflow": ("tensorflow",), "scikit-learn": ("scikit-learn", "sklearn"), "machine learning": ("machine learning",), "nlp": ("nlp",), "llm": ("llm", "llms"), "aws": ("aws", "amazon web services"), "gcp": ("gcp", "google cloud"), "azure": ("azure",), "docker": ("docker",), "kubernetes": ("kubernetes", "k8s"), "terraform": ("terraform",), "ansible": ("ansible",), "jenkins": ("jenkins",), "linux": ("linux",), "git": ("git",), "ci/cd": ("ci/cd",),
    "react": ("react", "reactjs", "react.js"), "react native": ("react native",), "vue": ("vue.js", "vuejs", "vue"), "angular": ("angular", "angularjs"), "svelte": ("svelte",), "next.js": ("next.js", "nextjs"), "node": ("node.js", "nodejs"), "express": ("express.js", "expressjs"), "nestjs": ("nestjs",), "html": ("html", "html5"), "css": ("css", "css3"), "graphql": ("graphql",), "rest": ("rest api", "restful", "rest apis"), "grpc": ("grpc",),
    "django": ("django",), "flask": ("flask",), "fastapi": ("fastapi",), "spring": ("spring boot", "spring"), ".net": (".net", "dotnet"), "postgresql": ("postgresql", "postgres"), "mysql": ("mysql",), "mongodb": ("mongodb", "mongo"), "redis": ("redis",), "elasticsearch": ("elasticsearch",), "cassandra": ("cassandra",), "oracle": ("oracle",), "rabbitmq": ("rabbitmq",), "selenium": ("selenium",), "cypress": ("cypress",), "figma": ("figma",), "salesforce": ("salesforce",), "sap": ("sap",),
}
#: Names that are words too. They count if written as names, in a sentence with a skill that is no word.
AMBIGUOUS_NAMES = frozenset(("go", "r", "spark", "react", "rust", "swift", "ruby", "spring", "express", "flask", "oracle", "looker", "rails", "cypress", "angular", "rest", "tableau", "cassandra", "vue", "scala", "sap"))
REQUIRED = re.compile(r"(?i)requir|must have|mandatory|obrigat|essential|requisitos")
PREFERRED = re.compile(r"(?i)nice to have|preferred|plus\b|diferencia|desej[aá]ve|bonus points")
_ALIAS = re.compile(r"(?<![\w+#&])(?:" + "|".join(re.escape(a) for a in sorted((a for xs in SKILLS.values() for a in xs), key=len, reverse=True)) + r")(?![\w+#&])", re.IGNORECASE)
_SKILL_OF = {a: name for name, aliases in SKILLS.items() for a in aliases}


def work_mode(title: Column, location: Column, description: Column) -> Column:
    """By title and place; only if they say nothing, by the description."""
    near = F.lower(F.concat_ws(" ", title, location))
    first = infer_unique({n: near.rlike(p) for n, p in WORK_MODES.items()})
    said = F.lit(False)
    for p in WORK_MODES.values():
        said = said | F.coalesce(near.rlike(p), F.lit(False))
    return F.when(said, first).otherwise(infer_unique({n: F.lower(description).rlike(p) for n, p in WORK_MODES.items()}))


def contract_type(text: Column) -> Column:
    return infer_unique({n: F.lower(text).rlike(p) for n, p in CONTRACTS.items()})


def recency_exempt(title: Column) -> Column:
    """Programmes whose postings stay up long after their date."""
    return F.coalesce(F.lower(title).rlike(PROGRAMS), F.lit(False))


YEARS = re.compile(r"(?i)\b(\d{1,2})\s*(?:\+|(?:-|–|to|a)\s*(\d{1,2}))?\s*(?:years|anos)\b(?!\s*(?:old|in (?:the )?(?:market|business)|de mercado))")


@dataclass(frozen=True)
class Rule:
    """A rule of a description: the years of experience that decide for a level."""

    name: str
    low: int
    high: int
    level: str


#: Years of experience by level.
YEAR_RULES = (Rule("years_junior", 0, 2, "JUNIOR"), Rule("years_mid", 3, 4, "MID"), Rule("years_senior", 5, 30, "SENIOR"))
#: A rule may decide once it has shown so precise, over so many labelled cases.
GATE, LEAST_EMISSIONS = 0.90, 20


def precise_rules(measured: dict[str, tuple[int, int]], rules: tuple[Rule, ...] = YEAR_RULES) -> tuple[Rule, ...]:
    """The rules that pass the gate by what was measured: name -> (right, all) over labelled rows. One that was not measured does not pass."""
    seen = {r.name: measured.get(r.name, (0, 0)) for r in rules}
    return tuple(r for r in rules if seen[r.name][1] >= LEAST_EMISSIONS and seen[r.name][0] >= GATE * seen[r.name][1])


def level_of_description(text: str | None, rules: tuple[Rule, ...] = YEAR_RULES) -> tuple[str, list[str]]:
    """(level, evidence) by the years asked for; ranges over several levels, or several demands that differ, veto."""
    hits = []
    for m in YEARS.finditer(text or ""):
        low = int(m[1])
        high = int(m[2]) if m[2] else low
        levels = {r.level for r in rules for years in (low, high) if r.low <= years <= r.high}
        company = re.search(r"(?i)\b(we|our company|founded|fundada)\b", text[max(0, m.start() - 40) : m.start()])
        if not company:
            hits.append((levels, m.group()))
    found = {x for levels, _ in hits for x in levels}
    return (found.pop() if len(found) == 1 else UNKNOWN), [e for _, e in hits]


@F.pandas_udf(T.StructType([T.StructField("level", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))]))
def seniority_from_description(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([level_of_description(t) for t in texts], columns=["level", "evidence"])


_FAMILY_PHRASES: list[Phrases] = []


def families_in(text: str | None) -> Counter[str]:
    """How often each family's phrases stand in a text, all found by one reading."""
    if not _FAMILY_PHRASES:
        _FAMILY_PHRASES.append(Phrases(tuple(Phrase("family", name, w.strip()) for name, words in FAMILIES for w in words.split(","))))
    return Counter(h.rule.value for h in _FAMILY_PHRASES[0].hits(WORDS.findall(folded(text or ""))))


def first_family(text: str | None) -> str | None:
    """The most specific family that a text names."""
    found = families_in(text)
    return next((n for n, _ in FAMILIES if n in found), None)


def family_of(title: str | None, department: str | None, description: str | None) -> tuple[str, str]:
    """(family, what told it): the title's most specific rule; a general title is refined by its department; the description only breaks ties."""
    by_title, by_department = first_family(title), first_family(department)
    if by_title and by_title != "SOFTWARE":
        return by_title, "title"
    if by_department and (by_title is None or by_department in TARGETS and by_department != "SOFTWARE"):
        return by_department, "department"
    if by_title:
        return by_title, "title"
    counts = families_in(description).most_common(2)
    clear = counts and counts[0][1] >= 2 and (len(counts) < 2 or counts[1][1] < counts[0][1])
    return (counts[0][0], "description") if clear else (UNKNOWN, "none")


@F.pandas_udf(T.StructType([T.StructField("family", T.StringType()), T.StructField("basis", T.StringType())]))
def role_family(titles: pd.Series, departments: pd.Series, descriptions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([family_of(t, d, x) for t, d, x in zip(titles, departments, descriptions, strict=True)], columns=["family", "basis"])


@F.pandas_udf(T.BooleanType())
def area_off_target(titles: pd.Series, departments: pd.Series) -> pd.Series:
    """Title and department both name an area outside of the wanted ones; one alone is not enough."""
    outside = lambda n: n is not None and n not in TARGETS
    return pd.Series([outside(first_family(t)) and outside(first_family(d)) for t, d in zip(titles, departments, strict=True)])


def countries_of(place: str | None) -> list[str] | None:
    """Countries that a place names; ANY for the world; null if unknown."""
    if not place or not place.strip():
        return None
    low = place.lower()
    if WORLD.search(low):
        return ["ANY"]
    found = {c for name, codes in REGIONS.items() if re.search(rf"\b{re.escape(name)}\b", low) for c in codes}
    segments = [s.strip(" .()") for s in re.split(r"[,;|/()-]", low)]
    found |= {COUNTRIES[s] for s in segments if s in COUNTRIES}
    return sorted(found) or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def allowed_countries(places: pd.Series) -> pd.Series:
    return pd.Series([countries_of(p) for p in places], dtype=object)


ELIGIBLE = re.compile(r"(?i)(?:must (?:be )?(?:based|located|reside)|only (?:candidates|applicants)?\s*(?:from|in)|eligible to work|authorized to work|open to candidates in|residir)\s*(?:in|from|no|na|em)?\s*(?:the )?([A-Za-zÀ-ÿ .]{2,30})")


def countries_of_description(text: str | None, by_place: list[str] | None) -> list[str] | None:
    """Explicit demands of a description; what disagrees with the place stays unknown."""
    found = {c for m in ELIGIBLE.finditer(text or "") for c in countries_of(re.split(r"\b(?:and|or|e|ou)\b|[.,]", m[1])[0]) or ()}
    if not found:
        return by_place
    if by_place and "ANY" not in by_place and not found & set(by_place):
        return None
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def described_countries(places: pd.Series, descriptions: pd.Series) -> pd.Series:
    return pd.Series([countries_of_description(d, countries_of(p)) for p, d in zip(places, descriptions, strict=True)], dtype=object)


def outside_countries(countries: Column, targets: list[str]) -> Column:
    """All named countries are others; anywhere and unknown are kept."""
    return countries.isNotNull() & ~F.arrays_overlap(countries, F.array(*map(F.lit, [*targets, "ANY"])))


def skills_of(text: str | None) -> list[tuple[str, str, str]]:
    """(skill, required or preferred, the sentence) of each skill, by its first mention."""
    text = text or ""
    edges = [-1, *(m.start() for m in re.finditer(r"[!?;\n]|[.](?=\s|$)", text)), len(text)]
    found: dict[str, tuple[str, str]] = {}
    for a, b in zip(edges, edges[1:]):
        hits = [(m.start(), m.group()) for m in _ALIAS.finditer(text, a + 1, b)]
        sure = any(x.lower() not in AMBIGUOUS_NAMES for _, x in hits)
        for at, written in hits:
            word = written.lower() in AMBIGUOUS_NAMES
            if (name := _SKILL_OF[written.lower()]) in found or word and not (sure and written[0].isupper()):
                continue
            before = text[max(0, at - 200) : at]
            marks = [(x.end(), kind) for kind, p in (("REQUIRED", REQUIRED), ("PREFERRED", PREFERRED)) for x in p.finditer(before)]
            found[name] = (max(marks)[1] if marks else UNKNOWN, text[a + 1 : b].strip())
    return sorted((n, kind, sentence) for n, (kind, sentence) in found.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("skill", T.StringType()), T.StructField("requirement", T.StringType()), T.StructField("evidence", T.StringType())])))
def extract_skills(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"skill": n, "requirement": k, "evidence": e} for n, k, e in skills_of(t)] for t in texts], dtype=object)


#: Phrases of young companies, and how strong each is.
SIGNALS = (("yc_batch", "strong", r"\b(?:yc|y combinator) ?\(?[sw]\d{2}\)?"), ("seed", "strong", r"\bseed[- ](?:round|funded|stage)\b"), ("early_stage", "weak", r"\bearly[- ]stage\b"), ("startup", "weak", r"\bstart-?up\b"))


def startup_evidence(text: Column) -> Column:
    """array<struct<signal, strength, snippet>> of the phrases that stand in a text."""
    low = F.lower(text)
    found = [F.when(low.rlike(p), F.struct(F.lit(n).alias("signal"), F.lit(s).alias("strength"), F.regexp_extract(low, f"({p})", 1).alias("snippet"))) for n, s, p in SIGNALS]
    return F.array_compact(F.array(*found))


def startup_summary(evidence: Column) -> Column:
    """Strong if anything is; else weak if there is anything."""
    return F.when(F.exists(evidence, lambda e: e["strength"] == "strong"), "strong").when(F.size(evidence) > 0, "weak")


def keywords(targets: Column, skills: Column, n: int) -> Column:
    """Wanted titles first, then the top skills; each once, in order."""
    return F.slice(F.array_distinct(F.concat(targets, skills)), 1, n)


def metadata_departments(metadata: str | None) -> list[str]:
    """Different department names from a record's nested shapes, in order."""
    try:
        record = json.loads(metadata or "{}")
    except ValueError:
        return []
    found: list[str] = []
    for key in ("departments", "department", "team", "categories"):
        value = record.get(key) if isinstance(record, dict) else None
        for x in value if isinstance(value, list) else [value]:
            name = x.get("name") or x.get("department") if isinstance(x, dict) else x
            if isinstance(name, str) and name.strip():
                found.append(name.strip())
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StringType()))
def departments_from_metadata(values: pd.Series) -> pd.Series:
    return pd.Series([metadata_departments(v) for v in values], dtype=object)
