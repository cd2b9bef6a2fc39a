"""Reports and smaller operators: residual duplicates, leaks between splits, storage, queues, listings, saved searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import dates, evaluation, hashing
from sievelake.operators import aggregates as A
from sievelake.operators import joins as J
from sievelake.operators.inbox import InboxQuery, conditions, ordering, pay_label
from sievelake.operators.latest import latest_by, page
from sievelake.operators import leaks
from sievelake.plans.base import at, query, table
from sievelake.session import dealt


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


ASSESSED_SQL = """
WITH f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'CLOSED' ELSE 'ACTIVE' END AS status, CASE WHEN o_totalprice > 250000 THEN 'HIGH_PRIORITY' WHEN o_totalprice > 150000 THEN 'RECOMMENDED' WHEN o_totalprice > 50000 THEN 'WATCHLIST' ELSE 'LOW_MATCH' END AS verdict,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE o_orderpriority END AS level, o_totalprice AS score, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS published, CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN ['ANY'] WHEN o_custkey % 6 < 4 THEN ['BR'] ELSE ['US'] END AS countries FROM orders)
"""


def assessed(spark, sf_dir):
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return orders(spark, sf_dir).select(
        key.alias("id"), F.when(F.col("o_orderstatus") == "P", "CLOSED").otherwise("ACTIVE").alias("status"), F.when(price > 250000, "HIGH_PRIORITY").when(price > 150000, "RECOMMENDED").when(price > 50000, "WATCHLIST").otherwise("LOW_MATCH").alias("verdict"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "UNKNOWN").otherwise(F.col("o_orderpriority")).alias("level"), price.alias("score"), F.when(key % 4 > 0, F.col("o_orderdate")).alias("published"),
        F.when(cust % 6 == 0, F.lit(None)).otherwise(F.array(F.when(cust % 6 == 1, "ANY").when(cust % 6 < 4, "BR").otherwise("US"))).alias("countries"),
    )


@query(ASSESSED_SQL + """SELECT id, verdict, level FROM f WHERE status <> 'CLOSED' AND (countries IS NULL OR list_has_any(countries, ['BR', 'ANY']))
ORDER BY CASE WHEN verdict IN ('HIGH_PRIORITY', 'RECOMMENDED') THEN 0 ELSE 1 END, CASE WHEN level IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, score DESC NULLS LAST, published DESC NULLS LAST, id LIMIT 25""")
def inbox_by_priority(spark, sf_dir):
    q = InboxQuery(countries=("BR",), limit=25)
    return page(assessed(spark, sf_dir).where(conditions(q, at("1998-08-02 00:00:00"))), ordering(q, ("1-URGENT", "2-HIGH")), q.limit).select("id", "verdict", "level")


@query(ASSESSED_SQL + """SELECT id, verdict, score FROM f WHERE status <> 'CLOSED' AND verdict IN ('WATCHLIST', 'RECOMMENDED') ORDER BY score DESC NULLS LAST, published DESC NULLS LAST, id LIMIT 30 OFFSET 30""")
def inbox_by_score(spark, sf_dir):
    q = InboxQuery(verdicts=("WATCHLIST", "RECOMMENDED"), order="SCORE", limit=30, offset=30)
    return page(assessed(spark, sf_dir).where(conditions(q, at("1998-08-02 00:00:00"))), ordering(q, ()), q.limit, q.offset).select("id", "verdict", "score")


@query(ASSESSED_SQL + """SELECT id, published FROM f WHERE level IN ('3-MEDIUM') ORDER BY published DESC NULLS LAST, id LIMIT 20""")
def inbox_by_recency(spark, sf_dir):
    q = InboxQuery(levels=("3-MEDIUM",), order="RECENCY", with_closed=True)
    return page(assessed(spark, sf_dir).where(conditions(q, at("1998-08-02 00:00:00"))), ordering(q, ()), q.limit).select("id", "published")


@query(ASSESSED_SQL + """
, p AS (SELECT *, CASE WHEN id % 3 > 0 THEN score / 100 END AS low, CASE WHEN id % 4 > 0 THEN score / 80 END AS high, CASE WHEN id % 2 = 0 THEN 'USD' ELSE 'BRL' END AS currency, CASE WHEN id % 7 = 0 THEN 'UNKNOWN' WHEN id % 7 < 5 THEN 'MONTH' ELSE 'YEAR' END AS period FROM f WHERE verdict IN ('WATCHLIST', 'RECOMMENDED')),
pays AS (SELECT id, low, high, currency, period FROM p WHERE id % 5 > 0 UNION ALL SELECT id, 1000, 2000, 'USD', 'MONTH' FROM p WHERE id % 6 = 1),
fit AS (SELECT DISTINCT id FROM pays WHERE currency = 'USD' AND period = 'MONTH' AND (high IS NULL OR high >= 1500) AND (low IS NULL OR low <= 2500)),
known AS (SELECT DISTINCT id FROM pays WHERE period <> 'UNKNOWN' AND (low IS NOT NULL OR high IS NOT NULL))
SELECT id, CASE WHEN fit.id IS NOT NULL THEN 'matched' ELSE 'unknown' END AS salary_match FROM p LEFT JOIN fit USING (id) LEFT JOIN known USING (id) WHERE fit.id IS NOT NULL OR known.id IS NULL""")
def inbox_by_salary(spark, sf_dir):
    """All postings of two verdicts within a range of pay; those without known pay are kept and labelled."""
    q = InboxQuery(verdicts=("WATCHLIST", "RECOMMENDED"), salary_min=1500, salary_max=2500, currency="USD", period="MONTH", with_closed=True)
    key = F.col("id")
    pay = lambda low, high, currency, period: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), currency.alias("currency"), period.alias("period"))
    own = pay(F.when(key % 3 > 0, F.col("score") / 100), F.when(key % 4 > 0, F.col("score") / 80), F.when(key % 2 == 0, "USD").otherwise("BRL"), F.when(key % 7 == 0, "UNKNOWN").when(key % 7 < 5, "MONTH").otherwise("YEAR"))
    other = pay(F.lit(1000), F.lit(2000), F.lit("USD"), F.lit("MONTH"))
    rows = assessed(spark, sf_dir).withColumn("pay", F.array_compact(F.array(F.when(key % 5 > 0, own), F.when(key % 6 == 1, other))))
    return rows.where(conditions(q, at("1998-08-02 00:00:00"))).select("id", pay_label(q).alias("salary_match"))


SAVED = (("top", '{"verdicts": ["HIGH_PRIORITY"]}'), ("brazil", '{"countries": ["BR"], "levels": ["1-URGENT"]}'), ("bad", '{"salary_min": 5}'), ("odd", '{"colour": "red"}'))


@query(ASSESSED_SQL + """
SELECT 'top' AS name, count(*) AS n, NULL::VARCHAR AS error FROM f WHERE status <> 'CLOSED' AND verdict = 'HIGH_PRIORITY' UNION ALL SELECT 'brazil', count(*), NULL FROM f WHERE status <> 'CLOSED' AND level = '1-URGENT' AND (countries IS NULL OR list_has_any(countries, ['BR', 'ANY']))
UNION ALL SELECT 'bad', NULL, 'a salary bound needs a currency and a period' UNION ALL SELECT 'odd', NULL, 'unknown filters'""")
def saved_search_summaries(spark, sf_dir):
    """Counts of all saved searches in one pass; one that can't be read has an error and no count."""
    read = {name: InboxQuery.saved(text) for name, text in SAVED}
    good = {name: conditions(q, at("1998-08-02 00:00:00")) for name, (q, error) in read.items() if q}
    counts = A.batch_counts(assessed(spark, sf_dir), "id", good).withColumnRenamed("query", "name")
    listed = spark.createDataFrame([(name, error) for name, (_, error) in read.items()], "name string, error string")
    return listed.join(counts, "name", "left").select("name", "n", "error")


@query("""
SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderkey <> a.o_orderkey AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 60 * 86400 * 1000000::BIGINT
  AND NOT EXISTS (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_suppkey = y.l_suppkey WHERE x.l_orderkey = a.o_orderkey AND y.l_orderkey = b.o_orderkey))""")
def residual_duplicates(spark, sf_dir):
    """Postings with a twin of the same company and title, close in time, that no source lists beside it."""
    sources = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("sources"))
    rows = orders(spark, sf_dir).join(sources, "o_orderkey", "left").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))
    other = rows.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("b_date"), F.col("sources").alias("b_sources"))
    twins = J.within(rows, other, ["o_custkey", "o_orderpriority"], "o_orderdate", "b_date", 60 * 86400)
    return twins.where((F.col("o_orderkey") != F.col("b")) & ~F.arrays_overlap("sources", "b_sources")).select("o_orderkey").distinct()


LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, (doc_id % 2 + 2) % 2 AS split, source AS name, regexp_extract_all(lower(coalesce(text, '')), '[^\s]+') AS w FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, split, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, split, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM k),
c AS (SELECT doc_id, split, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS mark FROM s GROUP BY 1, 2),
r AS (SELECT mark, min(doc_id) AS rid, any_value(n) AS n, bool_or(split = 0) AS in0, bool_or(split = 1) AS in1 FROM c GROUP BY 1),
t AS (SELECT r.rid, r.n, in0, in1, s FROM r JOIN s ON s.doc_id = r.rid),
i AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.s = b.s AND a.in0 AND b.in1 AND a.rid <> b.rid GROUP BY 1, 2, 3, 4)
SELECT 'member' AS kind, doc_id AS a, rid AS b, NULL::DOUBLE AS jaccard, NULL::VARCHAR AS name FROM c JOIN r USING (mark)
UNION ALL SELECT 'pair', a, b, round(CAST(i AS DOUBLE) / (na + nb - i), 6), NULL FROM i WHERE 5 * i >= 4 * (na + nb - i)
UNION ALL SELECT 'pair', rid, rid, 1.0, NULL FROM r WHERE in0 AND in1
UNION ALL SELECT 'group', min(doc_id) FILTER (WHERE split = 0), min(doc_id) FILTER (WHERE split = 1), NULL, name FROM d WHERE name IS NOT NULL GROUP BY name HAVING bool_or(split = 0) AND bool_or(split = 1)"""


@query(LEAKS_SQL)
def split_leaks(spark, sf_dir):
    """Leaks between two splits, in all languages, short texts and shared groups too (sources stand in for them)."""
    return leaks.split_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", F.pmod("doc_id", F.lit(2)), "source")


@query(LEAKS_SQL)
def split_leaks_whole(spark, sf_dir):
    """The same, by its older name."""
    return split_leaks(spark, sf_dir)


@query("""
WITH open AS (SELECT l_suppkey, max(l_shipdate) AS last FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l.l_suppkey, count(DISTINCT l_orderkey) AS postings, count(DISTINCT l_orderkey) FILTER (WHERE l_shipdate < last - INTERVAL 30 DAY) AS stale, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R' AND l_shipdate < last - INTERVAL 30 DAY) AS stale_off_target FROM lineitem l JOIN open USING (l_suppkey) GROUP BY 1""")
def stale_by_source(spark, sf_dir):
    """Different postings of each source, and how many of them are stale."""
    last = items(spark, sf_dir).where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    # a posting is stale if its earliest line is; each is one row of its source before it is counted
    returned = F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    lines = items(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_shipdate", "l_returnflag")
    each = dealt(lines, "l_suppkey", "l_orderkey").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_shipdate").alias("first"), returned.alias("returned"))
    stale = lambda c: F.count_if(F.col("l_orderkey").isNotNull() & (F.col(c) < F.col("last") - F.expr("INTERVAL '30' DAY")))
    return each.join(last, "l_suppkey").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("postings"), stale("first").alias("stale"), stale("returned").alias("stale_off_target"))


@query("""SELECT source, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS text_bytes, count(DISTINCT CASE WHEN n_chars < 200 THEN doc_id END) AS off_target FROM documents GROUP BY 1""")
def storage_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("text_bytes"), F.count_distinct(F.when(F.col("n_chars") < 200, F.col("doc_id"))).alias("off_target"))


@query("""SELECT event_type, count(*) FILTER (WHERE contains(lower(props), '"k": 1')) AS touched FROM events GROUP BY 1""")
def json_mentions(spark, sf_dir):
    """How many records mention a word anywhere in their JSON."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.lower("props").contains('"k": 1')).alias("touched"))


@query("""SELECT event_id FROM events WHERE json_extract_string(props, '$.lean') IS NULL AND coalesce(CAST(json_extract_string(props, '$.done') AS BOOLEAN), false) IS NOT TRUE AND event_type = 'view'""")
def not_yet_lean(spark, sf_dir):
    """A JSON flag that is absent is not true."""
    flag = F.get_json_object("props", "$.done").try_cast("boolean")
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.lean").isNull() & ~F.coalesce(flag, F.lit(False)) & (F.col("event_type") == "view")).select("event_id")


@query("""
WITH r AS (SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'purchase') AS relevant, count(*) FILTER (WHERE event_type = 'view') AS unknown FROM events GROUP BY 1)
SELECT CAST(sum(requests) AS BIGINT) AS requests, round(CAST(sum(unknown) AS DOUBLE) / nullif(sum(requests), 0), 6) AS unknown_rate, round(CAST(sum(relevant) AS DOUBLE) / nullif(sum(requests) - sum(unknown), 0), 6) AS precision, count(*) FILTER (WHERE relevant = 0) AS fruitless FROM r""")
def search_metrics(spark, sf_dir):
    """Sums over sources, and the rates that they make."""
    kind = F.col("event_type")
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(kind == "purchase").alias("relevant"), F.count_if(kind == "view").alias("unknown"))
    n, rel, unk = F.sum("requests"), F.sum("relevant"), F.sum("unknown")
    return r.agg(n.alias("total"), A.rate(unk, n).alias("unknown_rate"), A.rate(rel, n - unk).alias("precision"), F.count_if(F.col("relevant") == 0).alias("fruitless")).withColumnRenamed("total", "requests")


@query("""
WITH m AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey FROM customer LEFT JOIN m ON o_custkey = c_custkey WHERE coalesce(done, 0) < coalesce(n, 0) ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, last, c_custkey LIMIT 40""")
def evaluation_queue(spark, sf_dir):
    """What is not up to date, wanted areas first, the longest waiting next."""
    m = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("last"))
    waiting = table(spark, sf_dir, "customer").join(m, "c_custkey").where("done < n")
    return page(waiting, [F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.col("last"), F.col("c_custkey")], 40).select("c_custkey")


@query("""
WITH l AS (SELECT user_id, max(ts) AS finished FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT c_custkey, finished FROM customer LEFT JOIN l ON user_id = c_custkey ORDER BY finished DESC NULLS LAST, c_custkey LIMIT 60""")
def source_health_order(spark, sf_dir):
    """Newest finished first; those never finished last."""
    last = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("finished"))
    return page(table(spark, sf_dir, "customer").join(last, "c_custkey", "left"), [F.col("finished").desc_nulls_last(), F.col("c_custkey")], 60).select("c_custkey", "finished")


@query("""SELECT o_orderkey, l_linenumber, l_suppkey FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) l ON l_orderkey = o_orderkey WHERE rn <= 3 AND o_orderstatus <> 'P'""")
def open_occurrences(spark, sf_dir):
    """Occurrences that their source's newest runs still list."""
    newest = latest_by(items(spark, sf_dir), ["l_suppkey"], [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()], 3)
    return newest.join(orders(spark, sf_dir).where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT c_custkey AS id, 'linked' AS path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) UNION SELECT c_custkey, 'named' FROM customer WHERE c_name LIKE '%7' """)
def covered_companies(spark, sf_dir):
    """Companies covered by a link or by a configured name."""
    customers = table(spark, sf_dir, "customer")
    linked = customers.join(orders(spark, sf_dir).where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return linked.select(F.col("c_custkey").alias("id"), F.lit("linked").alias("path")).union(customers.where(F.col("c_name").endswith("7")).select("c_custkey", F.lit("named"))).distinct()


@query("""SELECT l_orderkey, greatest(max(l_shipdate), TIMESTAMP '1995-01-01') AS last_seen, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) AS latest_flag FROM lineitem GROUP BY 1""")
def presence_fold(spark, sf_dir):
    """Presence moves forward only, and brings its newest evidence along."""
    return items(spark, sf_dir).groupBy("l_orderkey").agg(F.greatest(F.max("l_shipdate"), at("1995-01-01 00:00:00")).alias("last_seen"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("latest_flag"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS suggested, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1""")
def suggestion_sets(spark, sf_dir):
    """The fields that have a suggestion, by posting."""
    return orders(spark, sf_dir).where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("suggested"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
WITH p AS (SELECT p_brand, p_size, avg(p_retailprice) FILTER (WHERE p_partkey % 2 = 0) AS before, avg(p_retailprice) FILTER (WHERE p_partkey % 2 = 1) AS after, count(*) FILTER (WHERE p_partkey % 2 = 0) AS nb, count(*) FILTER (WHERE p_partkey % 2 = 1) AS na FROM part GROUP BY 1, 2)
SELECT p_brand, p_size, CASE WHEN before IS NULL OR after IS NULL THEN NULL ELSE round(after - before, 6) END AS delta, CASE WHEN before IS NULL OR after IS NULL THEN 'refused' WHEN nb <> na THEN 'confounded' ELSE 'algorithm' END AS cause FROM p""")
def paired_deltas(spark, sf_dir):
    """Paired measures of two snapshots, and what a change may be put down to."""
    even = F.col("p_partkey") % 2 == 0
    mean = lambda c: F.avg(F.when(c, F.col("p_retailprice")))
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(mean(even).alias("before"), mean(~even).alias("after"), F.count_if(even).alias("nb"), F.count_if(~even).alias("na"))
    missing = F.col("before").isNull() | F.col("after").isNull()
    return p.select("p_brand", "p_size", F.when(~missing, F.round(F.col("after") - F.col("before"), 6)).alias("delta"), F.when(missing, "refused").when(F.col("nb") != F.col("na"), "confounded").otherwise("algorithm").alias("cause"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2""")
def failures_by_code(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderstatus <> 'O'").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CAST(to_json({'event_type': event_type, 'user_id': user_id}) AS VARCHAR) AS lean FROM events WHERE value > 90""")
def lean_payloads(spark, sf_dir):
    """What is left of a payload that nobody needs any more; absent fields take no room."""
    return table(spark, sf_dir, "events").where("value > 90").select("event_id", F.to_json(F.struct("event_type", "user_id", F.lit(None).cast("string").alias("dropped"))).alias("lean"))


@query("""SELECT event_id, (date_trunc('day', timezone('America/Sao_Paulo', timezone('UTC', ts))) - INTERVAL 1 DAY) AT TIME ZONE 'America/Sao_Paulo' AT TIME ZONE 'UTC' AS since FROM events""")
def summary_since(spark, sf_dir):
    """Yesterday's local midnight, in UTC."""
    return table(spark, sf_dir, "events").select("event_id", dates.yesterday_midnight(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("since"))


@query()
def summary_measures(spark, sf_dir):
    """How a generated answer bears out its source: turns stand in for both."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text"), ["conv_id", "turn"])
    claims = F.split("text", r"\.\s")
    return pairs.select("conv_id", "turn", evaluation.coverage(claims, F.col("source")).alias("coverage"), evaluation.fidelity(claims, F.col("source")).alias("fidelity"), evaluation.language_share(F.col("text")).alias("share"))


@query(r"""
WITH t AS (SELECT conv_id, turn, list_sort([lower(role), 'v1']) AS filters, trim(regexp_replace(role, '\s+', ' ', 'g')) AS role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, turn, sha256(CAST(to_json(filters) AS VARCHAR)) AS scope, sha256('{' || concat_ws(',', '"role":' || CAST(to_json(role) AS VARCHAR), '"text":' || CAST(to_json(text) AS VARCHAR)) || '}') AS digest FROM t""")
def analysis_keys(spark, sf_dir):
    """Equal inputs share an answer, whatever the order of their fields."""
    scope = hashing.scope_hash(F.array("role", F.lit("V1")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scope.alias("scope"), hashing.semantic_hash(F.to_json(F.struct("role", "text"))).alias("digest"))


@query("""
WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
SELECT o_custkey, round(quantile_cont(gap, 0.5), 4) AS p50, round(quantile_cont(gap, 0.95), 4) AS p95, count(gap) AS n FROM o WHERE gap >= 0 GROUP BY 1""")
def discovery_delay(spark, sf_dir):
    """Percentiles of delays that are not negative, linear between ranks."""
    gap = F.datediff("o_orderdate", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    rows = orders(spark, sf_dir).withColumn("gap", gap).where("gap >= 0").groupBy("o_custkey")
    return rows.agg(F.round(A.continuous("gap", 0.5), 4).alias("p50"), F.round(A.continuous("gap", 0.95), 4).alias("p95"), F.count("gap").alias("n"))


@query("""SELECT count(DISTINCT o_custkey) AS owners, count(DISTINCT o_custkey) <= 1 AS single FROM orders WHERE o_orderstatus = 'O'""")
def active_owners(spark, sf_dir):
    owners = F.count_distinct("o_custkey")
    return orders(spark, sf_dir).where("o_orderstatus = 'O'").agg(owners.alias("owners"), (owners <= 1).alias("single"))
