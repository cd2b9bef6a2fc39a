"""What single texts say: names, addresses, boards, levels, signals. Each query runs the library's function, its SQL states the expected value by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import classify, phrases, search, text, urls
from sievelake.plans.base import query, table


def pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


@query("""
WITH n AS (SELECT c_custkey, ['Ação', 'Müller & Söhne', ' Café—Bar ', 'L''Été S.A.', 'ACME, Inc.'][c_custkey % 5 + 1] AS a, c_mktsegment AS b FROM customer)
SELECT c_custkey, strip_accents(a) AS folded, trim(a) || ' ' || b AS cleaned, ['acao', 'muller sohne', 'cafebar', 'l ete s a', 'acme inc'][c_custkey % 5 + 1] || ' ' || lower(b) AS normal FROM n""")
def company_names(spark, sf_dir):
    """Names without accents, without outer space, and as plain words."""
    name = pick(("Ação", "Müller & Söhne", " Café—Bar ", "L'Été S.A.", "ACME, Inc."), F.col("c_custkey") % 5)
    whole = F.concat_ws(" ", name, "c_mktsegment")
    clean = F.concat_ws(" ", text.clean_text(name), text.clean_text(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\n"))))
    return table(spark, sf_dir, "customer").select("c_custkey", text.fold_accents(name).alias("folded"), clean.alias("cleaned"), text.normalize_name(whole).alias("normal"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '.example.com' WHEN 1 THEN 'b.example' WHEN 2 THEN 'xn--mller-kva.de' END AS domain, CASE page_id % 4 WHEN 0 THEN 'ftp://a' || page_id || '.example.com:21/x?a=1&b=2' WHEN 1 THEN 'https://b.example/' END AS canonical FROM pages""")
def addresses_read(spark, sf_dir):
    """Domains in ASCII without www, and canonical addresses of any scheme."""
    key = F.col("page_id").cast("string")
    said = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://A"), key, F.lit(".Example.com:21/x/?b=2&utm_source=q&a=1#top"))).when(F.col("page_id") % 4 == 1, "https://www.B.example.:443").when(F.col("page_id") % 4 == 2, "müller.de").otherwise(" ")
    shown = F.when(F.col("page_id") % 4 == 1, "https://b.example:443").otherwise(said)
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_domain(said).alias("domain"), urls.canonicalize_url(shown).alias("canonical"))


@query("""SELECT s_suppkey, [ 'greenhouse', 'lever', 'ashby', 'workable', 'teamtailor', 'workday', NULL ][s_suppkey % 7 + 1] AS kind, CASE WHEN s_suppkey % 7 < 6 THEN 'c' || s_suppkey END AS board, s_suppkey % 7 < 6 AS public FROM supplier""")
def boards_detected(spark, sf_dir):
    """Which public board an address is of, under which key, and whether it may be fetched at all."""
    key = F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))
    whole = lambda a, b: F.concat(F.lit(a), key, F.lit(b))
    kinds = [whole("https://boards.greenhouse.io/embed/job_board?for=", ""), whole("https://jobs.eu.lever.co/", "/x"), whole("https://jobs.ashbyhq.com/", "?a"), whole("http://apply.workable.com/", "/"), whole("https://", ".teamtailor.com/jobs"), whole("https://", ".wd3.myworkdayjobs.com/en"), whole("http://127.0.0.1/", "")]
    url = F.element_at(F.array(*kinds), (F.col("s_suppkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"))
    return rows.select("s_suppkey", urls.detect_board(F.col("url")).alias("b"), urls.is_public_destination("url").alias("public")).select("s_suppkey", "b.kind", F.col("b.key").alias("board"), "public")


@query("""
SELECT p_partkey, ['INTERN', 'JUNIOR', 'JUNIOR', 'MID', 'SENIOR', 'SENIOR', 'STAFF', 'LEAD', 'MANAGER', 'DIRECTOR', 'UNKNOWN', 'UNKNOWN', 'MID', 'SENIOR'][p_partkey % 14 + 1] AS level FROM part""")
def title_levels(spark, sf_dir):
    """Levels of titles: words, ranges, numerals, and phrases that only look like a level."""
    said = ("Estagiária de {}", "Júnior {}", "{} I", "{} Pl/Sr", "Sr. {}", "Senior/Staff {}", "Principal {}", "Tech Lead, {}", "Senior Manager, {}", "Head of {}", "Chief of Staff, {}", "Product Manager, {}", "{} (Mid-Level, Senior or Staff)", "{} III")
    title = F.replace(pick(said, F.col("p_partkey") % 14), F.lit("{}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.seniority(title).alias("level"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'yc_batch,startup' WHEN 1 THEN 'early_stage' WHEN 2 THEN 'seed' ELSE '' END AS signals, CASE s_suppkey % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 2 THEN 'strong' END AS strength,
  array_to_string(list_distinct_in_order, ',') AS keywords FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN ['data', 'sql', 'python'] WHEN 1 THEN ['data', 'python'] ELSE ['sql', 'data', 'python'] END AS list_distinct_in_order FROM supplier)""")
def startup_signals(spark, sf_dir):
    """Phrases of young companies with their strength, and keywords each once, in order."""
    said = pick(("A YC W21 start-up", "an early-stage team", "Seed-funded in May", "an old bank"), F.col("s_suppkey") % 4)
    found = classify.startup_evidence(said)
    some = lambda *x: F.array(*map(F.lit, x))
    third = F.col("s_suppkey") % 3
    targets = F.when(third == 0, some("data", "sql")).when(third == 1, some("data")).otherwise(some("sql"))
    skills = F.when(third == 0, some("data", "python", "go")).when(third == 1, some("python")).otherwise(some("data", "sql", "python", "go"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(found, lambda e: e["signal"]), ",").alias("signals"), classify.startup_summary(found).alias("strength"), F.array_join(classify.keywords(targets, skills, 3), ",").alias("keywords"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ',Ops' WHEN 1 THEN n_name WHEN 2 THEN 'Data,' || n_name ELSE '' END AS departments FROM nation""")
def departments_read(spark, sf_dir):
    """Department names from the nested shapes of records."""
    name = F.col("n_name")
    entry = lambda x: F.struct(x.alias("name"))
    kind = F.col("n_nationkey") % 4
    record = F.when(kind == 0, F.to_json(F.struct(F.array(entry(name), entry(F.lit("Ops")), entry(name)).alias("departments")))).when(kind == 1, F.to_json(F.struct(name.alias("team")))).when(kind == 2, F.to_json(F.struct(F.lit("Data").alias("department"), F.struct(name.alias("department")).alias("categories")))).otherwise("{broken")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(classify.departments_from_metadata(record), ",").alias("departments"))


@query("""SELECT p_partkey, sha256(CASE WHEN p_size % 2 = 0 THEN '["a",' ELSE '[' END || '"' || lower(p_brand) || '","z"]') AS scope FROM part""")
def scope_hashes(spark, sf_dir):
    """Equal filters have one hash, whatever their order and case."""
    from sievelake.functions import hashing

    filters = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Z"), F.col("p_brand"), F.lit("A"))).otherwise(F.array(F.upper("p_brand"), F.lit("z")))
    return table(spark, sf_dir, "part").select("p_partkey", hashing.scope_hash(filters).alias("scope"))


#: Every two neighbouring words of a benchmark item, as rules for the item, and the texts as folded words.
RULES_SQL = r"""b AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9+#]+') AS w FROM benchmark),
r AS (SELECT DISTINCT 'part' || item_id % 3 AS facet, CAST(item_id AS VARCHAR) AS value, w[k] || ' ' || w[k + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM b)),
t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z0-9+#]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM t)),
h AS (SELECT doc_id, facet, value, phrase FROM g JOIN r USING (phrase))"""


def benchmark_rules(spark, sf_dir):
    """Thousands of rules as a table: each two neighbouring words of an item speak for the item."""
    words = F.regexp_extract_all(F.translate(F.regexp_replace(F.lower("text"), r"\p{M}", ""), search.MARKED, search.PLAIN), F.lit("[a-z0-9+#]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where("size(w) > 1")
    each = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_join(F.slice("w", k, 2), " "))).alias("phrase"))
    return phrases.rules_of(each.select(F.concat(F.lit("part"), (F.col("item_id") % 3).cast("string")).alias("facet"), F.col("item_id").cast("string").alias("value"), "phrase"))


def phrases_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # else Spark's filter of what is exploded finds all evidence a second time, in a worker of its own
    found = phrases.evidence(docs, benchmark_rules(spark, sf_dir)).asNondeterministic()
    return docs.select("doc_id", found("text").alias("evidence"))


@query(f"""WITH {RULES_SQL}
SELECT doc_id, facet, count(*) AS n_rules, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN array_to_string(list_sort(list(DISTINCT value)), '|') END AS conflict FROM h GROUP BY 1, 2""")
def phrase_evidence(spark, sf_dir):
    """What thousands of rules find in whole texts, by document and facet: the one value that they speak for, or all that disagree."""
    facets = F.array(*[F.lit(f"part{k}") for k in range(3)])
    rows = phrases_found(spark, sf_dir).withColumn("facet", F.explode(facets))
    mine = F.filter("evidence", lambda e: e["facet"] == F.col("facet"))
    values = F.array_sort(F.array_distinct(F.transform(mine, lambda e: e["value"])))
    found = rows.select("doc_id", "facet", F.size(mine).cast("long").alias("n_rules"), values.alias("v")).where("n_rules > 0")
    return found.select("doc_id", "facet", "n_rules", F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("value"), F.when(F.size("v") > 1, F.array_join("v", "|")).alias("conflict"))


@query(f"""WITH {RULES_SQL}
SELECT facet, value, phrase, count(*) AS emitted, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS right_share, count(*) >= 5 AND count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*) >= 0.8 AS passes FROM h JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def measured_phrases(spark, sf_dir):
    """How often each rule speaks for labelled documents, how often rightly, and which may decide."""
    return phrases.measured(phrases_found(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", F.col("quality") == 1, 5, 0.8)
