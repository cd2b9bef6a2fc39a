"""Texts, URLs, labels and embeddings: normal forms, hashes, masks, terms, precision, search, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import classify, dates, hashing, money, search, text, urls, vectors
from sievelake.operators import aggregates as A
from sievelake.operators.inverted import session_index
from sievelake.operators.latest import latest_by, page
from sievelake.operators.nearest import nearest_by_cosine
from sievelake.operators.resolution import leaks, similar_titles
from sievelake.plans.base import query, table
from sievelake.session import scratch


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^\p{L}\p{N}+#]+', ' ', 'g')) AS title FROM part""")
def normalized_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_title(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("title"))


@query(r"""SELECT s_suppkey, trim(regexp_replace(lower(n_name || '   ' || r_name), '\s+', ' ', 'g')) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def normalized_places(spark, sf_dir):
    chain = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return chain.select("s_suppkey", text.normalize_location(F.concat("n_name", F.lit("   "), "r_name")).alias("place"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


@query(r"""
SELECT page_id, (regexp_matches(lower(url), '^[a-z]+://([^/?#]*\.)?example\.net([/:?#]|$)') AND regexp_matches(url, '^[a-z]+://[^/?#]*/de/')) OR regexp_matches(lower(url), '^[a-z]+://([^/?#]*\.)?casino-win\.example\.org([/:?#]|$)') AS forbidden FROM pages""")
def forbidden_hosts(spark, sf_dir):
    """Hosts, with their subdomains, and paths that may not be fetched."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", (urls.matches_rule(url, "example.net", "/de/") | urls.matches_rule(url, "casino-win.example.org")).alias("forbidden"))


@query(r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') AS bare, regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS q FROM pages),
k AS (SELECT page_id, rtrim(bare, '/') AS bare, array_to_string(list_sort(string_split(regexp_replace(regexp_replace('&' || q, '&(utm_[^&=]*|ref|source)=[^&]*', '', 'g'), '^&', ''), '&')), '&') AS q FROM c)
SELECT page_id, bare || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM k""")
def canonical_urls(spark, sf_dir):
    """One address for one page: no fragment, no tracking fields, sorted query."""
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("canonical"))


def masks_sql(column: str) -> str:
    """Every mask in order, each over what the ones before it left."""
    for pattern, by in text.MASKS:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


@query(f"""
WITH m AS (SELECT doc_id, {masks_sql('text')} AS masked FROM documents)
SELECT doc_id, sha256(masked) AS masked_sha256, CAST(length(masked) AS BIGINT) AS masked_chars FROM m""")
def masked_documents(spark, sf_dir):
    """Personal data replaced by what it was."""
    masked = documents(spark, sf_dir).select("doc_id", text.mask_personal(F.col("text")).alias("masked"))
    return masked.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").cast("long").alias("masked_chars"))


@query("""
SELECT doc_id, CASE WHEN trim(text) = '' OR text IS NULL THEN 'missing' WHEN length(trim(text)) < 200 OR NOT regexp_matches(text, '\\p{L}') THEN 'invalid' ELSE 'useful' END AS state,
CASE WHEN trim(text) = '' OR text IS NULL THEN NULL WHEN length(trim(text)) < 200 THEN 'too_short' WHEN NOT regexp_matches(text, '\\p{L}') THEN 'no_letters' END AS reason FROM documents""")
def description_states(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.description_state(F.col("text")).alias("s")).select("doc_id", "s.state", "s.reason")


@query(r"""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS term FROM documents), known(term) AS (VALUES ('with'), ('that'), ('this'))
SELECT term, count(*) AS n_docs FROM t WHERE term NOT IN (SELECT term FROM known) GROUP BY 1 HAVING count(*) >= 5""")
def unmatched_terms(spark, sf_dir):
    """In how many documents each term that no list knows stands: a document counts a term once."""
    known = spark.createDataFrame([("with",), ("that",), ("this",)], "term string")
    found = documents(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), 0))).alias("term"))
    return found.join(F.broadcast(known), "term", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 5")


@query("""
SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.99), 4) AS p99, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1""")
def length_distribution(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy("lang")
    return rows.agg(*[F.round(A.continuous("n_chars", p), 4).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.sum("n_chars").alias("total"))


@query("""SELECT doc_id, sha256(concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), CAST(n_chars AS VARCHAR), coalesce(text, ''))) AS fingerprint FROM documents""")
def fingerprints(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", hashing.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars"), F.col("text")).alias("fingerprint"))


@query("""
WITH m AS (SELECT o_orderkey, min(l_suppkey) AS source FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1)
SELECT o_orderkey, concat_ws('|', coalesce(CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END, 'name:' || lower(o_orderpriority)), o_orderstatus, coalesce(CAST(source AS VARCHAR), 'id:' || o_orderkey)) AS group_key FROM orders JOIN m USING (o_orderkey)""")
def posting_group_keys(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("source"))
    key = hashing.posting_group_key(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("source"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey", "left").select("o_orderkey", key.alias("group_key"))


@query("""SELECT page_id, coalesce('external:' || CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END, 'url:' || CASE WHEN page_id % 2 = 0 THEN url END, 'payload:' || sha256(html)) AS identity FROM pages""")
def identity_keys(spark, sf_dir):
    by_id, by_url = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")), F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.identity_key(by_id, by_url, F.sha2("html", 256)).alias("identity"))


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk FROM documents LEFT JOIN labels USING (doc_id) QUALIFY rk <= 50)
SELECT count(quality) AS judged, count(*) FILTER (WHERE quality = 1) AS relevant, round(CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / nullif(count(quality), 0), 6) AS precision, round(CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / 50, 6) AS precision_at_50 FROM r""")
def precision_at_k(spark, sf_dir):
    """Of the first fifty: over what was judged, and over all fifty."""
    top = page(documents(spark, sf_dir).select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 50).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    relevant = F.count_if(F.col("quality") == 1)
    return top.agg(F.count("quality").alias("judged"), relevant.alias("relevant"), A.rate(relevant, F.count("quality")).alias("precision"), A.rate(relevant, F.lit(50)).alias("precision_at_50"))


@query("""
SELECT source, count(*) AS n_docs, count(quality) AS judged, round(CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) / nullif(count(toxic), 0), 6) AS toxic_rate, round(100.0 * CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / nullif(count(*), 0), 6) AS yield_per_100 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def useful_yield(spark, sf_dir):
    """Rates by source; nothing judged is null, a measured zero is zero."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("judged"), A.rate(F.count_if(F.col("toxic") == 1), F.count("toxic")).alias("toxic_rate"), F.round(100.0 * F.try_divide(F.count_if(F.col("quality") == 1).cast("double"), F.count(F.lit(1))), 6).alias("yield_per_100"))


@query("""
WITH e AS (SELECT doc_id, quality = 1 AS eligible, length(text) > 1000 AS found FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS sample, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND found) AS found, round(CAST(count(*) FILTER (WHERE eligible AND found) AS DOUBLE) / nullif(count(*) FILTER (WHERE eligible), 0), 6) AS recall FROM e""")
def recall_of_sample(spark, sf_dir):
    """Recall from a labelled sample."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    eligible, found = F.col("quality") == 1, F.length("text") > 1000
    return rows.agg(F.count(F.lit(1)).alias("sample"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & found).alias("found"), A.rate(F.count_if(eligible & found), F.count_if(eligible)).alias("recall"))


@query("""
SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def profile_suggestions(spark, sf_dir):
    """Reasons given at least twice."""
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("toxic = 0").groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""
WITH r AS (SELECT c.conv_id, c.turn, c.role, length(c.text) AS n FROM conversations c)
SELECT role, count(*) AS n, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_chars, CAST(sum(CAST(ceil(n * 0.25) AS BIGINT)) AS BIGINT) AS tokens, round(quantile_cont(n, 0.95), 4) AS p95 FROM r GROUP BY 1""")
def token_calibration(spark, sf_dir):
    """Characters, and what they come to in tokens."""
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text")).groupBy("role")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n"), 6).alias("mean_chars"), F.sum(text.estimate_tokens(F.col("text"), 0.25)).alias("tokens"), F.round(A.continuous("n", 0.95), 4).alias("p95")).select("role", "n", "mean_chars", "tokens", "p95")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(q.v, v.v), 6) AS distance FROM q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM d) WHERE rn <= 10"""


@query(NEAREST_SQL)
def cosine_nearest(spark, sf_dir):
    """The ten nearest of all rows to every row whose id is divisible by 20, exactly, in blocks of both."""
    return nearest_by_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)


@query(NEAREST_SQL)
def cosine_nearest_whole(spark, sf_dir):
    """The same, by its older name."""
    return cosine_nearest(spark, sf_dir)


@query("""SELECT vec_id, len(embedding) = 64 AND NOT list_has_any(embedding::DOUBLE[], ['NaN'::DOUBLE, 'Infinity'::DOUBLE]) AS valid FROM embeddings""")
def vector_checks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.finite(F.col("embedding"), 64).alias("valid"))


@query("""
WITH g AS (SELECT min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY sha256(text))
SELECT sum(copies - 1)::BIGINT AS absorbed, count(*) AS kept, round(CAST(sum(copies - 1) AS DOUBLE) / nullif(sum(copies), 0), 6) AS duplicate_rate FROM g""")
def duplicate_rate(spark, sf_dir):
    groups = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.sum(F.col("copies") - 1).alias("absorbed"), F.count(F.lit(1)).alias("kept"), A.rate(F.sum(F.col("copies") - 1), F.sum("copies")).alias("duplicate_rate"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM benchmark),
dk AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d), bk AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM b),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS s FROM dk), bs AS (SELECT DISTINCT item_id, array_to_string(w[k:k+4], ' ') AS s FROM bk),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), hits AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, round(CAST(shared AS DOUBLE) / n, 6) AS contained FROM hits JOIN bn USING (item_id) WHERE CAST(shared AS DOUBLE) / n >= 0.5""")
def benchmark_leaks(spark, sf_dir):
    """Documents that hold half or more of a benchmark item's shingles."""
    return leaks(documents(spark, sf_dir).select(F.col("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id", 0.5)


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents)
SELECT doc_id FROM t WHERE list_contains(w, 'the') AND (list_contains(w, 'with') OR list_contains(w, 'from')) AND NOT list_contains(w, 'was')""")
def boolean_search(spark, sf_dir):
    """AND of OR-groups with an exclusion, over plain tokens."""
    asked = search.Query(((("the",),), (("with",), ("from",))), (("was",),))
    return words_index(spark, sf_dir).matches(asked).select(F.col("id").alias("doc_id"))


def words_index(spark, sf_dir):
    """Plain lower-case words of the texts."""
    empty = F.array().cast("array<string>")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    fields = [F.coalesce(words, empty) if f == "C" else empty for f in search.WEIGHTS]
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.struct(*[x.alias(f) for f, x in zip(search.WEIGHTS, fields, strict=True)]).alias("d"))
    return session_index(spark, sf_dir, "words", docs, scratch(spark, "words-index"))


def stems_index(spark, sf_dir):
    """Stems of the source, the language and the text."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), search.document(F.col("source"), F.col("lang"), F.col("text"), F.col("lang")).alias("d"))
    return session_index(spark, sf_dir, "stems", docs, scratch(spark, "stems-index"))


#: Stems of a text, written out by itself: what is cut, and which words only keep their place.
STEMS_SQL = r"""list_transform(regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[a-z0-9+#]+'), lambda w:
  CASE WHEN w IN ('a', 'an', 'and', 'as', 'at', 'be', 'by', 'de', 'da', 'do', 'das', 'dos', 'e', 'em', 'for', 'from', 'in', 'is', 'it', 'na', 'no', 'o', 'of', 'on', 'or', 'os', 'para', 'por', 'que', 'the', 'to', 'um', 'uma', 'with') THEN ''
  ELSE regexp_replace(regexp_replace(w, '^(.{{3,}}?)(amentos|amento|izations|ization|acoes|acao|ments|ment|ings|ing|edor|ers|er|oes|ed|es|s)$', '\1'), '^(.{{3,}})e$', '\1') END)"""


def ranks_sql(groups: list[list[str]], excluded: list[str]) -> str:
    """doc_id and rank of all documents with a stem of each group and none of two excluded stems in a row: covers by windows over each document's places."""
    n = len(groups)
    weight = "CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.2 ELSE 0.1 END"
    of_group = lambda k: "term IN (" + ", ".join(f"'{w}'" for w in groups[k]) + ")"
    at = ", ".join(f"last_value(CASE WHEN g = {k} THEN p END IGNORE NULLS) OVER o AS p{k}, last_value(CASE WHEN g = {k} THEN 1.0 / ({weight}) END IGNORE NULLS) OVER o AS w{k}" for k in range(n))
    left, weights = ", ".join(f"p{k}" for k in range(n)), " + ".join(f"w{k}" for k in range(n))
    some = " AND ".join(f"p{k} IS NOT NULL" for k in range(n))
    barred = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(excluded))
    return f"""WITH d AS (SELECT doc_id, {STEMS_SQL.format("source")} AS a, {STEMS_SQL.format("lang")} AS b, {STEMS_SQL.format("text")} AS c FROM documents),
s AS (SELECT doc_id, list_concat(list_concat(list_concat(a, ['']), list_concat(b, [''])), list_concat(list_concat(c, ['']), b)) AS t, len(a) AS la, len(b) AS lb, len(c) AS lc FROM d),
e AS (SELECT *, CASE WHEN p < la THEN 0 WHEN p < la + 1 + lb THEN 1 WHEN p < la + lb + 2 + lc THEN 2 ELSE 3 END AS f FROM
  (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p, la, lb, lc FROM s WHERE {f"len(list_filter(range(1, len(t)), lambda i: {barred})) = 0" if excluded else "true"})),
g AS (SELECT doc_id, p, f, g FROM ({" UNION ALL ".join(f"SELECT doc_id, p, f, {k} AS g FROM e WHERE {of_group(k)}" for k in range(n))})),
l AS (SELECT doc_id, p, g, {at} FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY p, g ROWS UNBOUNDED PRECEDING)),
m AS (SELECT doc_id, p, least({left}) AS l, {weights} AS w, lag(least({left})) OVER (PARTITION BY doc_id ORDER BY p, g) AS before FROM l WHERE {some})
SELECT doc_id, CAST(sum(CASE WHEN before IS NULL OR l > before THEN floor(1000000 * ({n} / w) / (1.0 + greatest(p - l + 1 - {n}, 0))) ELSE 0 END) AS DOUBLE) / 1000000 AS rank FROM m GROUP BY doc_id"""


@query(f"SELECT * FROM ({ranks_sql([['version', 'right', 'licens', 'general', 'token'], ['der', 'und', 'und', 'licens', 'mit', 'public']], ['all', 'right'])}) ORDER BY rank DESC, doc_id LIMIT 10")
def ranked_search(spark, sf_dir):
    """The ten best documents for a web-style query of many words, with an excluded phrase at its end."""
    asked = search.parse('version OR rights OR license OR general OR tokens der OR und OR "und" OR licensed OR mit OR public -"all rights"')
    return stems_index(spark, sf_dir).best(asked, 10).rows.select(F.col("id").alias("doc_id"), "rank")


#: Queries that the quality of the search is measured by, and what they ask for in stems.
JUDGED = (("license version", [["licens"], ["version"]]), ("general public", [["general"], ["public"]]), ("und der", [["und"], ["der"]]), ("license OR token", [["licens", "token"]]))


@query(
    "WITH t AS (SELECT count(*) AS relevant FROM labels WHERE quality = 1), i AS (SELECT relevant, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) x(k) WHERE k <= relevant) AS ideal FROM t), r AS ("
    + " UNION ALL ".join(f"SELECT '{text}' AS query, doc_id, row_number() OVER (ORDER BY rank DESC, doc_id) AS pos FROM ({ranks_sql(groups, [])})" for text, groups in JUDGED)
    + "), g AS (SELECT query, count(*) FILTER (WHERE quality = 1) AS hits, coalesce(sum(1 / log2(pos + 1)) FILTER (WHERE quality = 1), 0.0) AS dcg FROM r LEFT JOIN labels USING (doc_id) WHERE pos <= 10 GROUP BY 1)"
    + " SELECT query, round(CAST(hits AS DOUBLE) / nullif(relevant, 0), 6) AS recall_at_10, round(dcg / nullif(ideal, 0), 6) AS ndcg_at_10 FROM g, i"
)
def search_quality(spark, sf_dir):
    """Recall and nDCG of the first ten that each query finds, with documents labelled as good for binary gains."""
    index, labels = stems_index(spark, sf_dir), table(spark, sf_dir, "labels")
    ranked = [index.best(search.parse(text), 10).rows.withColumn("query", F.lit(text)) for text, _ in JUDGED]
    rows = reduce(DataFrame.unionByName, ranked).withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "id")))
    good = F.col("quality") == 1
    judged = rows.join(labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    found = judged.groupBy("query").agg(F.count_if(good).alias("hits"), F.sum(F.when(good, 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"))
    total = labels.agg(F.count_if(good)).collect()[0][0]
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda a, k: a + F.when(k <= F.lit(total), 1 / F.log2(k + 1)).otherwise(0.0))
    return found.select("query", A.rate(F.col("hits"), F.lit(total)).alias("recall_at_10"), F.round(F.try_divide(F.col("dcg"), ideal), 6).alias("ndcg_at_10"))


@query()
def page_texts(spark, sf_dir):
    """The visible text of raw pages."""
    shown = table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("visible"))
    return shown.select("page_id", "visible", F.length("visible").alias("n_chars"))


@query("""
WITH p AS (SELECT event_id, '"event_type":' || CAST(to_json(event_type) AS VARCHAR) AS a, '"props":' || CAST(to_json(props) AS VARCHAR) AS b, '"updated_at":"' || CAST(ts AS VARCHAR) || '"' AS c, '"user_id":' || user_id AS d FROM events)
SELECT event_id, sha256('{' || concat_ws(',', a, b, c, d) || '}') AS payload, sha256('{' || concat_ws(',', a, b, d) || '}') AS semantic FROM p""")
def payload_hashes(spark, sf_dir):
    """Hashes of nested records, whatever the order of their fields; a new etag is no change."""
    record = F.to_json(F.struct("event_type", "user_id", F.col("ts").cast("string").alias("updated_at"), "props"))
    return table(spark, sf_dir, "events").select("event_id", hashing.payload_hash(record).alias("payload"), hashing.semantic_hash(record).alias("semantic"))


@query("""
SELECT p_partkey, trim(['Senior', 'Junior', 'Staff', 'Mid/Senior', 'Lead', ''][p_size % 6 + 1] || ' ') || ' ' || ['Data Engineer', 'Backend Developer', 'Account Executive', 'UX Designer'][p_size % 4 + 1] AS title,
  CASE p_partkey % 5 WHEN 0 THEN 'REMOTE' WHEN 3 THEN 'REMOTE' ELSE 'UNKNOWN' END AS work_mode, 'CLT' AS contract, ['SENIOR', 'JUNIOR', 'STAFF', 'MID', 'LEAD', 'UNKNOWN'][p_size % 6 + 1] AS level,
  ['DATA_ENGINEERING', 'BACKEND', 'SALES', 'DESIGN'][p_size % 4 + 1] AS family, [ 'BR', 'AR,BR,CL,CO,MX', 'DE', 'ANY', NULL ][p_partkey % 5 + 1] AS countries, CAST(3 AS INTEGER) AS n_skills, CAST(round_even(p_retailprice, 0) AS DECIMAL(14, 2)) AS pay, false AS exempt FROM part""")
def classified_parts(spark, sf_dir):
    """Work mode, contract, level, family, skills and pay read from made-up postings of the parts table."""
    title = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("Senior", "Junior", "Staff", "Mid/Senior", "Lead", ""))), (F.col("p_size") % 6 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Data Engineer", "Backend Developer", "Account Executive", "UX Designer"))), (F.col("p_size") % 4 + 1).cast("int")))
    place = F.element_at(F.array(*map(F.lit, ("Remote, Brazil", "LATAM", "Berlin, Germany", "Anywhere", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    body = F.concat(F.lit("Requirements: 5+ years of experience with Python and SQL. Nice to have: Kafka. We pay USD "), F.format_number("p_retailprice", 0), F.lit(" per month. CLT."))
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), place.alias("place"), body.alias("body"))
    return rows.select(
        "p_partkey", "title", classify.work_mode(F.col("title"), F.col("place"), F.col("body")).alias("work_mode"), classify.contract_type(F.col("body")).alias("contract"), classify.seniority("title").alias("level"), classify.role_family("title", F.lit(None).cast("string"), "body")["family"].alias("family"),
        F.array_join(classify.allowed_countries("place"), ",").alias("countries"), F.size(classify.extract_skills("body")).alias("n_skills"), money.text_compensation("body")["amount_min"].alias("pay"), classify.recency_exempt(F.col("title")).alias("exempt"),
    )


@query()
def likely_same_titles(spark, sf_dir):
    """Pairs of one brand and size whose titles look alike by their matching blocks, and which parts have one title."""
    return similar_titles(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("block"), F.concat_ws(" ", "p_name", "p_type").alias("title")), "p_partkey", "block", "title", 0.55)


@query("""SELECT user_id, CASE WHEN n > 0 THEN least(60.0 * pow(2, n - 1), 3600.0) ELSE 0.0 END AS backoff FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)""")
def backoff(spark, sf_dir):
    failures = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return failures.select("user_id", dates.backoff_seconds(F.col("n"), 60.0, 3600.0).alias("backoff"))


@query("""
WITH v AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS short FROM documents GROUP BY 1)
SELECT sha256(string_agg(source || ':' || n || ':' || short, ';' ORDER BY source)) AS digest, count(*) AS sources, CAST(sum(n) AS BIGINT) AS rows FROM v""")
def source_baseline(spark, sf_dir):
    """A digest of each source's counts, so that two snapshots compare at a glance."""
    counts = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 200).alias("short"))
    line = F.concat_ws(":", "source", F.col("n").cast("string"), F.col("short").cast("string"))
    return counts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("source", line.alias("line"))))["line"], ";"), 256).alias("digest"), F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, regexp_replace(line, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS line FROM l),
h AS (SELECT *, i = 0 OR (length(line) BETWEEN 3 AND 60 AND regexp_matches(line, '^(#+\s*|\*\*)?[A-ZÀ-Ý][^.!?]*:?\**$')) AS begins FROM t),
s AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM h),
p AS (SELECT doc_id, part, bool_or(line <> '') AS has_text, bool_or(begins AND regexp_matches(line, '(?i)^[^\p{L}\p{N}_]*(requirements?|qualifications?|requisitos|qualifica|responsibilit|responsabilidades|what you|about the role|sobre a vaga|benef|salary|sal[aá]rio)')) AS leads FROM s GROUP BY 1, 2)
SELECT doc_id, count(*) FILTER (WHERE has_text) AS n_sections, count(*) FILTER (WHERE has_text AND leads) AS n_first FROM p GROUP BY 1""")
def section_counts(spark, sf_dir):
    """Sections of whole texts, cut at headings, and how many of them come first."""
    parts = text.section_parts(F.col("text"))
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.size(parts).cast("long").alias("n_sections"), F.size(F.filter(parts, lambda p: p["first"])).cast("long").alias("n_first"))
