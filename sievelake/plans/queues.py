"""Queues, gates and measures of review over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import evaluation
from sievelake.functions.predicates import contains_any
from sievelake.operators import queues as Q
from sievelake.operators.latest import rotated
from sievelake.plans.base import query, table

FIELDS = ("family", "level", "work_mode")
AFTER = ("1994-06-01 00:00:00", 100)


@query(f"""
WITH p AS (SELECT o_orderkey AS id, o_orderdate AS created, o_orderkey % 3 AS version, o_custkey % 4 = 0 AS family, o_orderkey % 3 = 0 AS level, o_orderkey % 5 = 0 AS work_mode, o_orderstatus FROM orders),
s AS (SELECT DISTINCT l_orderkey AS id, l_linenumber % 3 AS version, CASE l_returnflag WHEN 'A' THEN 'family' WHEN 'N' THEN 'level' ELSE 'work_mode' END AS field FROM lineitem),
f AS (SELECT id, created, version, unnest(list_filter(['family', 'level', 'work_mode'], lambda x: (x = 'family' AND family) OR (x = 'level' AND level) OR (x = 'work_mode' AND work_mode))) AS field FROM p WHERE o_orderstatus = 'O')
SELECT id, created, string_agg(field, ',' ORDER BY field) AS pending FROM f WHERE (created > TIMESTAMP '{AFTER[0]}' OR (created = TIMESTAMP '{AFTER[0]}' AND id > {AFTER[1]})) AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = f.id AND s.version = f.version AND s.field = f.field)
GROUP BY 1, 2 ORDER BY created, id LIMIT 40""")
def suggestion_queue(spark, sf_dir):
    """A page of postings with an unknown field, no suggestion for it in this version, and a top verdict: the page's size is the feature."""
    key = F.col("o_orderkey")
    said = lambda flag: F.when(flag, "UNKNOWN").otherwise("KNOWN")
    postings = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderdate").alias("created"), (key % 3).alias("version"), said(F.col("o_custkey") % 4 == 0).alias("family"), said(key % 3 == 0).alias("level"), said(key % 5 == 0).alias("work_mode"))
    field = F.when(F.col("l_returnflag") == "A", "family").when(F.col("l_returnflag") == "N", "level").otherwise("work_mode")
    suggestions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).cast("long").alias("version"), field.alias("field"))
    assessments = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(F.col("o_orderstatus") == "O", "RECOMMENDED").otherwise("LOW_MATCH").alias("verdict"))
    found = Q.suggestion_queue(postings, FIELDS, suggestions, assessments, ["HIGH_PRIORITY", "RECOMMENDED"], 40, AFTER)
    return found.select("id", "created", F.array_join("pending", ",").alias("pending"))


@query("""
WITH r AS (SELECT c_custkey AS id, 'x' || c_custkey % 9 AS ext, CASE WHEN c_custkey % 5 > 0 THEN 'place' || c_custkey % 3 END AS place, ['REMOTE', 'ONSITE', 'UNKNOWN'][c_custkey % 3 + 1] AS mode FROM customer),
c AS (SELECT o_custkey AS id, o_orderkey % 41 > 0 AS there, CASE WHEN o_orderkey % 37 > 0 THEN ['x' || o_orderkey % 9] END AS exts, CASE WHEN o_orderkey % 4 > 0 THEN 'place' || o_orderkey % 5 ELSE '' END AS place, ['REMOTE', 'ONSITE', 'UNKNOWN'][o_orderkey % 3 + 1] AS mode FROM orders WHERE o_orderkey % 6 = 0),
m AS (SELECT r.id, coalesce(c.there, false) AND coalesce(len(exts) > 0, false) AND NOT coalesce(list_contains(exts, ext), false) AND (coalesce(r.place <> '' AND c.place <> '' AND r.place <> c.place, false) OR coalesce(r.mode <> 'UNKNOWN' AND c.mode <> 'UNKNOWN' AND r.mode <> c.mode, false)) AS sure FROM r LEFT JOIN c USING (id))
SELECT id, bool_and(sure) AS "distinct" FROM m GROUP BY 1""")
def distinct_postings(spark, sf_dir):
    """Rows that surely are postings of their own, by all their candidates."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    mode = lambda x: F.element_at(F.array(F.lit("REMOTE"), F.lit("ONSITE"), F.lit("UNKNOWN")), (x % 3 + 1).cast("int"))
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), named("x", k % 9).alias("external_id"), F.when(k % 5 > 0, named("place", k % 3)).alias("location"), mode(k).alias("work_mode"))
    candidates = table(spark, sf_dir, "orders").where(o % 6 == 0).select(F.col("o_custkey").alias("id"), (o % 41 > 0).alias("there"), F.when(o % 37 > 0, F.array(named("x", o % 9))).alias("external_ids"), F.when(o % 4 > 0, named("place", o % 5)).otherwise("").alias("location"), mode(o).alias("work_mode"))
    return Q.distinct_postings(rows, candidates)


@query("""
SELECT doc_id, CAST(ceil(n_chars * 0.3) AS BIGINT) AS estimated, CAST(8000 - 1000 - CASE WHEN doc_id % 3 = 0 THEN doc_id % 700 ELSE 800 END AS BIGINT) AS budget, ceil(n_chars * 0.3) <= 8000 - 1000 - CASE WHEN doc_id % 3 = 0 THEN doc_id % 700 ELSE 800 END AS fits FROM documents""")
def prompt_budgets(spark, sf_dir):
    """What a prompt may use and what each text is estimated to; a measured margin takes the place of the tenth."""
    budget = Q.prompt_budget(8000, 1000, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 700))
    need = Q.estimated_tokens(F.col("n_chars"), 0.3)
    return table(spark, sf_dir, "documents").select("doc_id", need.alias("estimated"), budget.alias("budget"), (need <= budget).alias("fits"))


@query("""
WITH m AS (SELECT 'good' AS gate, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels UNION ALL SELECT 'returned', avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL SELECT 'errors', avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM events UNION ALL SELECT 'errors', 0.0),
g AS (SELECT * FROM (VALUES ('good', 0.4, true), ('toxic', 0.9, false), ('returned', 0.1, false), ('errors', 0.5, false), ('never measured', 0.0, true)) v(gate, bound, at_least)),
r AS (SELECT g.gate, CASE WHEN count(value) = 1 THEN min(value) END AS value, bound, at_least FROM g LEFT JOIN m USING (gate) GROUP BY ALL),
p AS (SELECT gate, value, coalesce(CASE WHEN at_least THEN value >= bound ELSE value <= bound END, false) AS passes FROM r)
SELECT gate, round(value, 6) AS value, passes, (SELECT bool_and(passes) FROM p) AS ready FROM p""")
def rollout_gates(spark, sf_dir):
    """What a rollout has to show: measures of the tables against bounds; what is not measured, or twice, fails."""
    share = lambda name, column, gate: table(spark, sf_dir, name).agg(F.avg(column).alias("value")).select(F.lit(gate).alias("gate"), "value")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    measures = share("labels", F.col("quality"), "good").union(share("labels", F.col("toxic"), "toxic")).union(share("lineitem", one(F.col("l_returnflag") == "R"), "returned")).union(share("events", one(F.col("event_type") == "error"), "errors")).union(share("events", F.lit(0.0), "errors"))
    gates = spark.createDataFrame([("good", 0.4, True), ("toxic", 0.9, False), ("returned", 0.1, False), ("errors", 0.5, False), ("never measured", 0.0, True)], Q.GATES)
    return Q.rollout(measures, gates).withColumn("value", F.round("value", 6))


@query("""
WITH e AS (SELECT user_id AS id, ts, event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"no": "array"}' WHEN 2 THEN '[]' ELSE '["' || event_type || '", "ops"]' END AS said FROM events), n AS (SELECT id, arg_max({'said': said}, (ts, event_id)).said AS said FROM e GROUP BY 1)
SELECT id, CASE WHEN said = '[]' THEN '' WHEN said LIKE '[%' THEN replace(replace(replace(said, '["', ''), '"]', ''), '", "', ',') END AS departments, CASE WHEN said IS NULL THEN 'MISSING' WHEN said LIKE '{%' THEN 'MALFORMED' END AS error FROM n""")
def latest_departments(spark, sf_dir):
    """Departments by each posting's newest occurrence; evidence that is missing or of another shape is told, not taken for none."""
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.lit(None)).when(k == 1, '{"no": "array"}').when(k == 2, "[]").otherwise(F.concat(F.lit('["'), "event_type", F.lit('", "ops"]')))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("last_seen"), F.col("event_id").alias("occurrence"), said.alias("departments"))
    return Q.latest_departments(rows).select("id", F.array_join("departments", ",").alias("departments"), "error")


#: Folded words of a text.
WORDS_SQL = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[a-z0-9+#]+')"
PORTUGUESE_SQL = "'a', 'ao', 'as', 'com', 'como', 'da', 'das', 'de', 'do', 'dos', 'e', 'em', 'mais', 'na', 'nas', 'no', 'nos', 'nao', 'o', 'os', 'ou', 'para', 'por', 'que', 'se', 'sem', 'sua', 'um', 'uma', 'vaga'"
MEASURES_SQL = f"""
WITH q AS (SELECT a.conv_id, b.turn, a.text AS source, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user' AND b.role = 'assistant'),
w AS (SELECT conv_id, turn, {WORDS_SQL.format("source")} AS have, {WORDS_SQL.format("answer")} AS said, unnest(regexp_split_to_array(answer, '\\.\\s')) AS claim FROM q),
c AS (SELECT *, {WORDS_SQL.format("claim")} AS words FROM w),
m AS (SELECT conv_id, turn, any_value(said) AS said, count(*) AS n, count(*) FILTER (WHERE len(list_filter(words, lambda x: NOT list_contains(have, x))) = 0) AS held, count(*) FILTER (WHERE len(list_filter(words, lambda x: NOT list_contains(have, x) AND (regexp_full_match(x, '[0-9]+') OR length(x) > 3))) > 0) AS made FROM c GROUP BY 1, 2),
r AS (SELECT conv_id, turn, CAST(held AS DOUBLE) / n AS coverage, 1 - CAST(made AS DOUBLE) / n AS fidelity, CASE WHEN len(said) > 0 THEN CAST(len(list_filter(said, lambda x: x IN ({PORTUGUESE_SQL}))) AS DOUBLE) / len(said) END AS share FROM m)"""


def measured(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    pairs = asked.join(turns.where("role = 'assistant'").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    claims = F.split("text", r"\.\s")
    return pairs.where("text is not null").select("conv_id", "turn", evaluation.coverage(claims, F.col("source")).alias("coverage"), evaluation.fidelity(claims, F.col("source")).alias("fidelity"), evaluation.language_share(F.col("text")).alias("share"))


@query(MEASURES_SQL + " SELECT conv_id, turn, round(coverage, 6) AS coverage, round(fidelity, 6) AS fidelity, round(share, 6) AS share FROM r")
def answer_measures(spark, sf_dir):
    """How each answer bears out what was asked, claim by claim, by built-in functions."""
    return measured(spark, sf_dir).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("coverage", "fidelity", "share")])


@query(MEASURES_SQL + """ SELECT CASE conv_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(avg(coverage), 6) AS coverage, count(coverage) AS n_coverage, round(avg(fidelity), 6) AS fidelity, count(fidelity) AS n_fidelity, round(avg(share), 6) AS share, count(share) AS n_share FROM r GROUP BY 1""")
def measures_by_split(spark, sf_dir):
    """Means by split, over the answers that have a measure."""
    split = F.element_at(F.array(F.lit("dev"), F.lit("test"), F.lit("train")), (F.col("conv_id") % 3 + 1).cast("int"))
    return Q.means(measured(spark, sf_dir).withColumn("split", split), ["split"], ["coverage", "fidelity", "share"])


@query("SELECT doc_id, text ILIKE '%mit license%' OR text ILIKE '%general public%' OR text ILIKE '%der %' AS hinted FROM documents WHERE text IS NOT NULL")
def hinted_documents(spark, sf_dir):
    """Whether any of some hints stands in a text, whatever its case."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", contains_any(F.col("text"), ("MIT License", "general public", "Der ")).alias("hinted"))


@query("""
WITH t AS (SELECT p_type AS term, row_number() OVER (ORDER BY p_type) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part))
SELECT term FROM t WHERE (k - (3 * 4) % n + n) % n < least(4, n)""")
def rotated_terms(spark, sf_dir):
    """The block of terms whose turn it is, over the end and on from the start: terms are a list of bounded size."""
    terms = [r.p_type for r in table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").collect()]
    return spark.createDataFrame([(t,) for t in rotated(terms, 4, 3)], "term string").select("term")
