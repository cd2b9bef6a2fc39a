"""Text: normal forms, HTML, sections, masks and states. Built-in expressions where they have the semantics, Arrow batches where not."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(texts: pd.Series, f) -> pd.Series:
    return pd.Series([None if t is None else f(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """Compatibility form, without outer space; nothing left is null."""
    return _each(texts, lambda t: unicodedata.normalize("NFKC", t).strip() or None)


@F.pandas_udf(T.StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Letters without their marks."""
    return _each(texts, lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def normalize_name(texts: pd.Series) -> pd.Series:
    """A company's name as ASCII words in lower case."""
    ascii_of = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold()
    return _each(texts, lambda t: " ".join(re.findall(r"[a-z0-9]+", ascii_of(t))))


def normalize_title(title: Column) -> Column:
    """Lower-case letters and digits, and the + and # of languages; all else is one space. A sharp s is two, as when case is folded."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(title), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}+#]+", " "))


def normalize_location(place: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(place), r"\s+", " "))


class _Text(HTMLParser):
    """Visible text: blocks on lines of their own, list items with a bullet, no scripts or styles."""

    BLOCKS = frozenset("p div section article header footer h1 h2 h3 h4 h5 h6 ul ol table tr br hr blockquote pre".split())
    HIDDEN = frozenset(("script", "style", "template", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS or tag == "li":
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


ESCAPED = re.compile(r"&(?:amp;)*lt;")


def visible_text(source: str) -> str:
    """Escaped markup is unescaped first, as often as it was escaped: each round leaves fewer characters."""
    while ESCAPED.search(source):
        source = html.unescape(source)
    parser = _Text()
    parser.feed(source)
    parser.close()
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in lines if x != "-")).strip()


@F.pandas_udf(T.StringType())
def html_to_text(sources: pd.Series) -> pd.Series:
    return _each(sources, visible_text)


#: What is masked, in this order, and by what.
MASKS = (
    (r"(https?://)?(www\.)?(linkedin\.com/in|github\.com|gitlab\.com)/[^\s)]+", "[personal-url]"),
    (r"\bBearer [A-Za-z0-9._-]{16,}", "[secret]"),
    (r"\b(sk|pk|rk|gsk|tvly|hf|npm|shpat|glpat|gh[oprsu]|xox[abeoprs])[-_][A-Za-z0-9_-]{16,}", "[secret]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[tax-id]"),
    (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[card]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]"),
    (r"(\+\d{1,3}[ -]?)?\(\d{2,3}\) ?\d{3,5}-\d{4}", "[phone]"),
    (r"(\+\d{1,3}[ -]?)?\b\d{2,3}[ -]\d{4,5}-\d{4}\b", "[phone]"),
)
#: Fields of a record that hold personal data.
PERSONAL_KEYS = frozenset("name full_name first_name last_name email phone telephone address birth_date cpf document linkedin github photo".split())


def without_personal(value):
    """A record without its personal fields, at any depth; its texts are left for mask_personal."""
    if isinstance(value, dict):
        return {k: without_personal(v) for k, v in value.items() if k.lower() not in PERSONAL_KEYS}
    return [without_personal(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def drop_personal_keys(records: pd.Series) -> pd.Series:
    """Of JSON records; what is no JSON is null, as it can't be told what it holds."""

    def dropped(text: str) -> str | None:
        try:
            return json.dumps(without_personal(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return _each(records, dropped)


def mask_personal(text: Column) -> Column:
    for pattern, by in MASKS:
        text = F.regexp_replace(text, pattern, F.lit(by))
    return text


#: A useful description has as many characters at least, and is none of the placeholders.
USEFUL_CHARS = 200
PLACEHOLDERS = r"^\s*(n/?a|none|tbd|null|undefined|-+|lorem ipsum.*)\s*$"


def description_state(text: Column) -> Column:
    """struct<state, reason>: missing, invalid for a reason, or useful."""
    bare = F.btrim(text)
    reason = F.when(bare.isNull() | (bare == ""), F.lit(None)).when(F.lower(bare).rlike(PLACEHOLDERS), "placeholder").when(F.length(bare) < USEFUL_CHARS, "too_short").when(bare.rlike(r"^[^\p{L}]*$"), "no_letters")
    state = F.when(bare.isNull() | (bare == ""), "missing").when(reason.isNotNull(), "invalid").otherwise("useful")
    return F.struct(state.alias("state"), reason.alias("reason"))


def estimate_tokens(text: Column, tokens_per_char: float) -> Column:
    return F.ceil(F.length(text) * F.lit(tokens_per_char)).cast("long")


#: Headings that a section of requirements, duties or terms starts with; all other sections come after these.
PRIORITY = re.compile(r"(?i)^\W*(requirements?|qualifications?|requisitos|qualifica|responsibilit|responsabilidades|what you|about the role|sobre a vaga|benef|salary|sal[aá]rio)")
HEADING = re.compile(r"^(?=.{3,60}$)(?:#+\s*|\*\*)?[A-ZÀ-Ý][^.!?]*:?\**$")


def sections(text: str) -> list[tuple[bool, str]]:
    """(whether it comes first, text) of each section, cut at headings."""
    found: list[list[str]] = [[]]
    for line in text.split("\n"):
        if HEADING.match(line.strip()) and found[-1]:
            found.append([])
        found[-1].append(line)
    return [(bool(PRIORITY.match(part[0].strip())), "\n".join(part).strip()) for part in found if "".join(part).strip()]


def at_sentence(text: str, limit: int) -> str:
    """Cut after the last whole sentence within the limit, or at the last space if there is none."""
    if len(text) <= limit:
        return text
    head = text[:limit]
    end = max((m.end() for m in re.finditer(r"[.!?](?=\s|$)|\n", head)), default=0)
    return head[: end or (head.rfind(" ") if " " in head else limit)].rstrip()


def fitted(text: str, limit: int) -> str:
    """Sections of requirements and terms first, each in its old order, as far as the limit reaches."""
    if len(text) <= limit:
        return text
    kept, left = [], limit
    for _, part in sorted(sections(text), key=lambda s: not s[0]):
        part = at_sentence(part, left)
        if part:
            kept.append(part)
        left -= len(part) + 1
        if left <= 0:
            break
    return "\n".join(kept)


#: What Python strips, for Java's expressions.
_SPACE = r"[\s\x1c-\x1f]"


def _java(pattern: str) -> str:
    """A pattern of this module as Java reads it alike: any letter's case, any script's words, the line's own end."""
    return "(?iuUs)" + pattern.removeprefix("(?i)").replace("$", r"\z")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def _pieces(lines: Column, begins: Callable[[Column], Column]) -> Column:
    """Lines cut into runs, each from a line that begins one: by the numbers of those lines, and of the next ones."""
    numbers = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | begins(F.get(lines, i)))
    ends = F.concat(F.slice(numbers, 2, F.size(numbers)), F.array(F.size(lines)))
    return F.zip_with(numbers, ends, lambda a, b: F.slice(lines, a + 1, b - a))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def section_parts(text: Column) -> Column:
    """sections(), by built-in functions: array<struct<first, text>>."""
    heading = _java(HEADING.pattern).replace("(?iuUs)", "(?s)")
    parts = _bound(F.split(text, "\n"), lambda lines: _pieces(lines, lambda line: _stripped(line).rlike(heading)))
    said = F.transform(parts, lambda p: F.struct(_stripped(F.get(p, F.lit(0))).rlike(_java(PRIORITY.pattern)).alias("first"), _stripped(F.array_join(p, "\n")).alias("text")))
    return F.filter(said, lambda p: p["text"] != "")


def _at_sentence(text: Column, limit: Column) -> Column:
    def cut(head: Column) -> Column:
        whole = F.regexp_extract(head, rf"(?sU)\A(.*(?:[.!?](?={_SPACE}|\z)|\n))", 1)
        return F.regexp_replace(F.when(whole != "", whole).when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)\A(.*) ", 1)).otherwise(head), rf"(?U){_SPACE}+\z", "")

    return F.when(F.length(text) <= limit, text).otherwise(_bound(F.substring(text, 1, limit), cut))


def truncate_at_sentence(text: Column, limit: int) -> Column:
    """at_sentence(), by built-in functions."""
    return _at_sentence(text, F.lit(limit))


def fit_by_section(text: Column, limit: int) -> Column:
    """fitted(), by built-in functions: the sections in their order of use, and a running rest of the limit."""

    def step(state: Column, part: Column) -> Column:
        def take(piece: Column) -> Column:
            kept = F.when(piece != "", F.array_append(state["kept"], piece)).otherwise(state["kept"])
            return F.struct(kept.alias("kept"), (state["left"] - F.length(piece) - 1).cast("int").alias("left"))

        return F.when(state["left"] > 0, _bound(_at_sentence(part["text"], state["left"]), take)).otherwise(state)

    ordered = _bound(section_parts(text), lambda p: F.concat(F.filter(p, lambda x: x["first"]), F.filter(p, lambda x: ~x["first"])))
    nothing = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(limit).alias("left"))
    return F.when(F.length(text) <= limit, text).otherwise(F.aggregate(ordered, nothing, step, lambda s: F.array_join(s["kept"], "\n")))


#: Lines that say nothing of the posting itself, and facts for which a line stays anyway.
BOILERPLATE = re.compile(r"(?i)equal opportunity|all rights reserved|privacy policy|cookies|follow us|about us|quem somos|siga-nos|pol[ií]tica de privacidade")
DECISIVE = re.compile(r"(?i)\b(remote|remoto|hybrid|h[ií]brido|visa|clt|pj|salary|sal[aá]rio|usd|brl|eur|r\$|timezone|fuso)\b")


def without_boilerplate(text: str) -> str:
    """Boilerplate goes, from its line to the next blank one, but for lines with a decisive fact."""
    kept, dropping = [], False
    for line in text.split("\n"):
        if not line.strip():
            dropping = False
        elif BOILERPLATE.search(line):
            dropping = True
        if not dropping or DECISIVE.search(line):
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def clean_description(text: Column) -> Column:
    """without_boilerplate(), by built-in functions: runs of lines between blank ones, cut at their first line of boilerplate."""
    said = lambda line, pattern: line.rlike(_java(pattern.pattern))

    def kept(run: Column) -> Column:
        flags = F.transform(run, lambda line: said(line, BOILERPLATE))
        return _bound(F.array_position(flags, True), lambda first: F.filter(run, lambda line, i: (first == 0) | (i < first - 1) | said(line, DECISIVE)))

    runs = _bound(F.split(text, "\n"), lambda lines: _pieces(lines, lambda line: _stripped(line) == ""))
    return _stripped(F.regexp_replace(F.array_join(F.flatten(F.transform(runs, kept)), "\n"), r"\n{3,}", "\n\n"))


def departments(*sources: Column) -> Column:
    """Different names from arrays of several shapes, in the order in which they come."""
    everything = F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sources]))
    return F.array_distinct(F.filter(F.transform(everything, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != "")))


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two titles by their longest matching blocks; an edit distance is not the same."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
