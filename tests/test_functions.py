"""Functions on small tables of behaviour."""

import datetime as dt
import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelake.functions import classify, dates, hashing, money, predicates, search, text, urls


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_names_and_texts(spark):
    assert column(spark, ["  Ａcme ", " ", None], text.clean_text) == ["Acme", None, None]
    assert column(spark, ["São João", None], text.fold_accents) == ["Sao Joao", None]
    assert column(spark, ["Ação & Cia. Ltda", "ﬁn-Tech"], text.normalize_name) == ["acao cia ltda", "fin tech"]
    assert column(spark, ["Sr. C++ / C# Dev!", "Désigner"], text.normalize_title) == ["sr c++ c# dev", "désigner"]
    assert column(spark, ["&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "<ul><li>a</li><li>b</li></ul><script>x</script>"], text.html_to_text) == ["Hi & bye", "- a\n\n- b"]
    assert column(spark, ["a b. c d. e", "abc def"], lambda c: text.truncate_at_sentence(c, 6)) == ["a b.", "abc"]
    body = "About things. Nothing.\nRequirements\nPython. SQL."
    assert column(spark, [body], lambda c: text.fit_by_section(c, 28))[0].startswith("Requirements")
    assert column(spark, ["x\nEqual opportunity employer\nmore\n\nremote"], text.clean_description) == ["x\n\nremote"]
    assert column(spark, ["a@b.example.com 10.0.0.1 4111 1111 1111 1111 (11) 5555-1234"], text.mask_personal) == ["[email] [ip] [card] [phone]"]
    assert [s.state for s in column(spark, [None, "n/a", "x" * 300, "1" * 300], text.description_state)] == ["missing", "invalid", "useful", "invalid"]


def test_urls(spark):
    assert column(spark, ["HTTPS://A.example:443/b/?utm_x=1&z=2&a=1#f", "ftp://x/y", "", "http://a.example"], urls.normalize_url) == ["https://a.example/b?a=1&z=2", None, None, "http://a.example/"]
    assert column(spark, ["https://www.Bücher.example/x", "a.example", None], urls.normalize_domain) == ["xn--bcher-kva.example", "a.example", None]
    assert [b and (b.kind, b.key) for b in column(spark, ["https://jobs.lever.co/acme/1", "https://boards.greenhouse.io/x", "https://a.example"], urls.detect_board)] == [("lever", "acme"), ("greenhouse", "x"), None]
    assert column(spark, ["https://a.b.example/de/x", "https://xb.example/de/", "https://b.example"], lambda c: urls.matches_rule(c, "b.example", "/de/")) == [True, False, False]
    assert column(spark, ["http://127.0.0.1/", "http://10.1.1.1", "https://a.example", "file:///x", "http://localhost", "http://u@a.example"], urls.is_public_destination) == [False, False, True, False, False, False]
    rules = urls.robots_rules("User-agent: *\nDisallow: /a\n\nUser-agent: Bot\nDisallow: /b # no\nDisallow:", "my-bot/1")
    assert rules == ["/b"] and urls.robots_rules("User-agent: *\nDisallow: /a", "x") == ["/a"]


def test_hashes(spark):
    a, b, c = column(spark, ['{"x": 1, "y": "a  b"}', '{"y":"a  b","x":1}', "{bad"], hashing.payload_hash)
    assert a == b and c is None
    a, b, c = column(spark, ['{"x": "a  b", "etag": 1}', '{"x": "a b", "etag": 2}', '{"x": "c"}'], hashing.semantic_hash)
    assert a == b != c
    a, b = column(spark, [["B", "a"], ["A", "b"]], hashing.scope_hash, "array<string>")
    assert a == b


def test_money(spark):
    assert [str(x) for x in column(spark, ["1.234,56", "1,234.56", "1.234", "12k", "5 mil"], money.money_amount)] == ["1234.56", "1234.56", "1234.00", "12000.00", "5000.00"]
    found = column(spark, ["R$ 8.000 a R$ 12.000 por mês", "pays $100k-120k yearly gross", "a $500 bonus", None, "100 people"], money.text_compensation)
    assert [(int(f.amount_min), int(f.amount_max), f.currency, f.period) if f.currency else None for f in found] == [(8000, 12000, "BRL", "MONTH"), (100000, 120000, "USD", "YEAR"), None, None, None]
    assert column(spark, ["per month or per year", "monthly"], money.period_from_text) == [None, "MONTH"]


def test_levels_and_families(spark):
    titles = ["Senior Data Engineer", "Sr. Staff Engineer", "Junior/Mid Developer", "Engineer II", "Estagiário", "Head of Sales", "Engineer", None]
    assert column(spark, titles, classify.seniority) == ["SENIOR", "STAFF", "JUNIOR", "MID", "INTERN", "DIRECTOR", "UNKNOWN", "UNKNOWN"]
    assert classify.level_of_description("5+ years of experience") == ("SENIOR", ["5+ years"])
    assert classify.level_of_description("1-2 years or 6 years")[0] == "UNKNOWN"
    assert classify.level_of_description("our company has 20 years of history")[0] == "UNKNOWN"
    assert classify.level_of_description("3 years", classify.precise_rules({"years_junior": (40, 41), "years_mid": (30, 40), "years_senior": (19, 19)}))[0] == "UNKNOWN"
    assert [r.name for r in classify.precise_rules({"years_junior": (40, 41), "years_mid": (30, 40), "years_senior": (19, 19)})] == ["years_junior"]
    assert classify.family_of("Software Engineer", "Data Science", None) == ("UNKNOWN", "none") or classify.family_of("Software Engineer", "Data Scientist", None)[0] == "DATA_SCIENCE"
    assert classify.family_of("Backend Developer", "Sales", None) == ("BACKEND", "title")
    df = spark.createDataFrame([("Account Executive", "Sales"), ("Data Engineer", "Sales"), ("Account Executive", None)], "t string, d string")
    assert [r.x for r in df.select(classify.area_off_target("t", "d").alias("x")).collect()] == [True, False, False]


def test_places_skills_and_modes(spark):
    assert column(spark, ["Remote, Brazil", "LATAM", "Anywhere", "Mars", None], classify.allowed_countries) == [["BR"], ["AR", "BR", "CL", "CO", "MX"], ["ANY"], None, None]
    assert classify.countries_of_description("You must be located in Canada.", ["BR"]) is None
    assert classify.countries_of_description("You must be located in Canada.", None) == ["CA"]
    skills = classify.skills_of("Requirements: Python and Go. Nice to have: Kafka.")
    assert [(n, k) for n, k, _ in skills] == [("go", "REQUIRED"), ("kafka", "PREFERRED"), ("python", "REQUIRED")]
    assert classify.skills_of("let us go and react") == []
    names = lambda t: [n for n, _, _ in classify.skills_of(t)]
    assert names("We plan to react quickly; a spark of SQL. R&D") == ["sql"]
    assert names("React, TypeScript and Node.js on AWS. Spring is here.") == ["aws", "node", "react", "typescript"]
    assert names("R, Python or Spark with .NET and C++") == [".net", "c++", "python", "r", "spark"]
    df = spark.createDataFrame([("Dev", "Remote", ""), ("Dev", "Remote or hybrid", ""), ("Dev", "", "work is on-site"), ("Dev", "", "")], "t string, l string, d string")
    assert [r.x for r in df.select(classify.work_mode(F.col("t"), F.col("l"), F.col("d")).alias("x")).collect()] == ["REMOTE", "UNKNOWN", "ONSITE", "UNKNOWN"]
    assert classify.metadata_departments('{"departments": [{"name": "A"}, {"name": "B"}], "team": "A"}') == ["A", "B"]


def test_recency_grid(spark):
    """All combinations of dates, programme and deadline, against plain Python."""
    now = dt.datetime(2024, 3, 1)
    days = lambda n: None if n is None else now - dt.timedelta(days=n)
    grid = list(itertools.product((None, 5, 20, 45), (None, 5, 20, 45), (1, 20, 45), (False, True), (None, -3, 3)))
    rows = [(k, days(p), days(u), days(s), e, days(v)) for k, (p, u, s, e, v) in enumerate(grid)]
    df = spark.createDataFrame(rows, "k int, p timestamp_ntz, u timestamp_ntz, s timestamp_ntz, e boolean, v timestamp_ntz")
    for window in (30, 14):
        d = predicates.recency_decision(F.col("p"), F.col("u"), F.col("s"), F.col("e"), F.col("v"), F.lit("2024-03-01").cast("timestamp_ntz"), window)
        got = {r.k: r.d for r in df.select("k", d.alias("d")).collect()}
        for k, (p, u, s, e, v) in enumerate(grid):
            basis, age = next((n, x) for n, x in (("published", p), ("updated", u), ("first_seen", s)) if x is not None)
            assert got[k].visible == (age <= window or e or (v is not None and v < 0))
            assert (got[k].basis, got[k].estimated) == (basis, basis != "published")


@pytest.mark.parametrize("schedule,after,want", [("*/15 2 * * 1-5", (2024, 1, 6, 3, 0), (2024, 1, 8, 2, 0)), ("0 0 29 2 *", (2023, 1, 1, 0, 0), (2024, 2, 29, 0, 0)), ("30 6 1 * 0", (2024, 1, 2, 0, 0), (2024, 1, 7, 6, 30))])
def test_schedules(schedule, after, want):
    assert dates.next_fire(schedule, dt.datetime(*after)) == dt.datetime(*want)
    assert dates.cadence("0 */6 * * *") == 6 * 3600


def test_search(spark):
    docs = [("Senior Data Engineer", "python", "Builds pipelines in the cloud", "Remote"), ("Frontend Developer", "react", "Remote work on the front end", "Lisbon"), ("Data Analyst", "sql", "All rights reserved", "Porto")]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "k int, a string, b string, c string, d string").select("k", search.document(*map(F.col, "abcd")).alias("doc"))
    found = lambda q: [r.k for r in df.where(search.matches(F.col("doc"), search.parse(q))).orderBy("k").collect()]
    assert found("data") == [0, 2]
    assert found("data -analyst") == [0]
    assert found('"data engineer"') == [0] and found('"engineer data"') == []
    assert found("programmer") == [0, 1]  # by its synonyms
    assert found("python or react") == [0, 1]
    assert found("pipeline clouds") == [0]  # by its stems
    assert found("the") == [] and found("") == []
    q = search.parse("data")
    assert df.select("k", search.rank(F.col("doc"), q).alias("r")).orderBy(F.desc("r")).first().k in (0, 2)


def test_inbox_queries():
    from sievelake.operators.inbox import Gate, InboxQuery, rollout

    for bad in ({"salary_min": 1.0}, {"salary_min": 3.0, "salary_max": 1.0, "currency": "USD", "period": "YEAR"}, {"order": "X"}, {"limit": 0}):
        with pytest.raises(ValueError):
            InboxQuery(**bad)
    assert InboxQuery.saved('{"levels": ["MID"], "limit": 5}') == (InboxQuery(levels=("MID",), limit=5), None)
    for text in ("[]", "{", '{"x": 1}', '{"limit": "a"}'):
        q, error = InboxQuery.saved(text)
        assert q is None and error
    gates = (Gate("precision", 0.9), Gate("p95", 2.0, False))
    assert rollout({"precision": 0.95, "p95": 1.0}, gates) == (True, [])
    assert rollout({"precision": 0.8}, gates) == (False, ["precision", "p95"])


def test_evaluation():
    from sievelake.functions import evaluation

    assert evaluation.covered(["python sql", "java"], "SQL e Python") == 0.5 and evaluation.covered([], "x") is None
    assert evaluation.invented(["pays 100", "uses Python"], "We use python; uses") == ["pays 100"]
    assert evaluation.portuguese_share("a vaga é boa") == 0.75 and evaluation.portuguese_share("") is None


#: Titles made up here, by the level that they are to have.
TITLES = {
    "INTERN": ("Chemistry Internship", "Working Student, Robotics", "Estagiário(a) em Física", "Apprentice Welder", "Senior Trainee Programme"),
    "JUNIOR": ("Jr Surveyor", "Geóloga Júnior", "Entry-Level Chemist", "New Grad Botanist", "Surveyor I", "Associate Botanist", "Junior to Senior Chemist", "Associate Botanist II", "Júnior(a) / Pleno(a)"),
    "MID": ("Mid-Level Chemist", "Geóloga Plena", "Pl. Geologist", "Intermediate Welder", "Chemist II", "Pleno/Sênior em Química", "Mid, Senior or Staff Chemist", "Chemist II - III", "Semi-Senior Welder"),
    "SENIOR": ("Sr Chemist", "Química Sênior", "Chemist III", "Landscape Architect", "Senior Category Manager", "Senior Chemist I", "Senior / Principal Welder", "Senior, Project Manager"),
    "STAFF": ("Senior Staff Chemist", "Principal Release Manager", "Especialista em Solos", "Staff Architect"),
    "LEAD": ("Líder de Laboratório", "Lead Welder", "Team Lead | Principal"),
    "MANAGER": ("Manager of Senior Chemists", "Gerente de Campo", "Associate Manager", "Lead Manager, Soils"),
    "DIRECTOR": ("Head of Soils", "Senior Director, Labs", "Diretora de Campo", "VP Chemistry"),
    "UNKNOWN": ("Chief of Staff", "Technical Staff", "PL/SQL Tuner", "Middle East Geologist", "Graduate School Tutor", "Internal Surveyor", "Internationalist", "Property Manager", "i like welding", "", "Welder", None),
}


def test_levels_of_titles():
    from sievelake.functions import classify

    for level, titles in TITLES.items():
        assert {t: classify.level_of(t) for t in titles} == dict.fromkeys(titles, level)


def test_phrases_are_found_at_words_edges(spark):
    from sievelake.functions import phrases

    rules = tuple(phrases.Rule(*r) for r in (("a", "x", "big data"), ("a", "y", "data eng*"), ("b", "z", "É ok"), ("a", "x", "data"), ("b", "none", "!!")))
    found = phrases.Phrases(rules)
    got = phrases.evidence_of("Big-Data engineering; bigdata. É OK? data", found)
    assert got == [("a", "x", "big data", 0, 1), ("a", "x", "data", 1, 2), ("a", "y", "data eng*", 1, 1), ("b", "z", "É ok", 4, 1)]
    assert [(h.rule.phrase, h.at) for h in found.longest(["big", "data", "engineering"])] == [("big data", 0)]
    assert phrases.evidence_of(None, found) == [] and phrases.evidence_of("data", phrases.Phrases(())) == []
    df = spark.createDataFrame([(1, "Big data engineer"), (2, "e ok"), (3, None)], "k int, t string")
    rows = df.select("k", phrases.evidence(df, rules)("t").alias("e")).select("k", phrases.verdict(F.col("e"), "a").alias("a"), phrases.verdict(F.col("e"), "b").alias("b")).collect()
    assert {r.k: (tuple(r.a), tuple(r.b)) for r in rows} == {1: ((None, "x|y"), (None, None)), 2: ((None, None), ("z", None)), 3: ((None, None), (None, None))}


def test_thousands_of_rules_cost_what_few_do():
    """Time by rule count: an automaton reads a text once."""
    import time

    from sievelake.functions import phrases

    text = " ".join(f"w{k % 977} v{k % 13}" for k in range(20_000))
    took = []
    for n in (10, 20_000):
        found = phrases.Phrases(tuple(phrases.Rule("f", str(k), f"q{k} v{k % 7}") for k in range(n)))
        found.hits(phrases.WORDS.findall(text))
        began = time.perf_counter()
        for _ in range(3):
            found.hits(phrases.WORDS.findall(text))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_native_tokens_are_the_terms(spark):
    from sievelake.functions import search

    said = ["The Developers' licences, versions & RIGHTS of C++ and C#", "Engenheiros e programações em São Paulo", "Müller naïve façade e\u0301t\u00e9 e", "s es the", None, "", "agreements organizations 12 e eee bee"]
    assert column(spark, said, search.tokens) == [search.terms(t) for t in said]


def test_evidence_is_held_for_few_texts_at_once(spark, monkeypatch):
    from sievelake.functions import phrases

    yielded = []
    monkeypatch.setattr(phrases.F, "pandas_udf", lambda _: lambda f: f)
    found = phrases.evidence(spark.range(1), (phrases.Rule("a", "x", "data"),))
    monkeypatch.setattr(phrases, "compiled", lambda _: phrases.Phrases((phrases.Rule("a", "x", "data"),)))
    for part in found(iter([pd.Series(["data"] * 1_000)])):
        yielded.append(len(part))
    assert sum(yielded) == 1_000 and max(yielded) <= 256


def test_measured_evidence_is_found_once_by_small_batches(spark):
    """Explode's own filter must not run the automaton again."""
    from sievelake.plans import registry

    found = registry.QUERIES["measured_phrases"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "10000"


def test_many_pieces_of_few_texts_are_passed_on(spark, monkeypatch):
    from sievelake.functions import phrases

    rules = tuple(phrases.Rule("f", "v", f"word{k}") for k in range(3_000))
    monkeypatch.setattr(phrases.F, "pandas_udf", lambda _: lambda f: f)
    found = phrases.evidence(spark.range(1), rules)
    text = " ".join(f"word{k}" for k in range(3_000))
    parts = [[len(x) for x in part] for part in found(iter([pd.Series([text, None, *[text] * 30])]))]
    assert sum(parts, []) == [3_000, 0, *[3_000] * 30] and max(map(sum, parts)) <= phrases.PIECES + 3_000
