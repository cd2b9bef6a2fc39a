"""Entities and order-dependent state: merges with their chains, companies by all their keys, admitted requests, cached reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import entities as E
from sievelake.operators import resolution as R
from sievelake.plans.base import query, table
from sievelake.streaming import keyed

#: Candidate pairs of one customer's orders within 60 days, what refuses a pair by itself, and the components of the rest.
MERGES_SQL = """WITH RECURSIVE p AS (SELECT o_orderkey AS id, o_orderdate AS created, o_custkey, o_orderstatus = 'P' AS active FROM orders),
c AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id % 5 = 0 THEN 'REJECTED' WHEN a.id % 11 = 0 THEN 'VERSION' WHEN a.id % 17 = 0 OR b.id % 17 = 0 THEN 'CYCLE' END AS refused
  FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.id < b.id AND abs(epoch_us(a.created) - epoch_us(b.created)) <= 60 * 86400 * 1000000::BIGINT),
e AS (SELECT a, b FROM c WHERE refused IS NULL UNION SELECT b, a FROM c WHERE refused IS NULL),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
m AS (SELECT node, min(other) AS cluster, arg_min(p.id, (p.created, p.id)) AS survivor, count(*) FILTER (WHERE p.active) > 1 AS conflict FROM (SELECT DISTINCT node, other FROM reach) JOIN p ON p.id = other GROUP BY node)"""


def merges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("version", F.col("o_orderkey") % 3)
    pairs = R.candidate_pairs(rows.select("o_custkey", "o_orderkey", "o_orderdate", "version"), ["o_custkey"], "o_orderkey", "o_orderdate", 60)
    candidates = pairs.withColumns({"status": F.when(F.col("a") % 5 == 0, "REJECTED").otherwise("PENDING"), "a_version": F.col("a_version") + F.when(F.col("a") % 11 == 0, 1).otherwise(0)})
    postings = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), "version", F.when(F.col("o_orderkey") % 17 == 0, F.lit(-1)).alias("duplicate_of"))
    return E.settled_merges(candidates, postings, rows.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@query(f"""{MERGES_SQL}
SELECT c.a, c.b, coalesce(refused, CASE WHEN conflict THEN 'CONFLICT' ELSE 'CONFIRM' END) AS outcome, CASE WHEN refused IS NULL AND NOT conflict THEN survivor END AS survivor FROM c LEFT JOIN m ON m.node = c.a""")
def settled_merges(spark, sf_dir):
    """What becomes of each confirmation of a batch, chains settled at once, and which posting survives."""
    return merges(spark, sf_dir)[0]


@query(f"""{MERGES_SQL}
SELECT l_orderkey, l_linenumber, CASE WHEN conflict = false THEN survivor ELSE l_orderkey END AS posting, coalesce(NOT conflict AND survivor <> l_orderkey, false) AS moved FROM lineitem LEFT JOIN m ON node = l_orderkey""")
def moved_occurrences(spark, sf_dir):
    """Occurrences under the posting that survives the batch's merges."""
    absorbed = merges(spark, sf_dir)[1].select(F.col("absorbed").alias("l_orderkey"), "survivor")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(absorbed, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("survivor", "l_orderkey").alias("posting"), F.col("survivor").isNotNull().alias("moved"))


@query("""
WITH RECURSIVE r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE 'n' || (c_custkey // 2) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'd' || (c_custkey % 40) || '.example' END AS domain, CASE WHEN c_custkey % 7 = 0 THEN 'n' || (c_custkey // 2 + 1) END AS alias, true AS new FROM customer
  UNION ALL SELECT -1 - s_suppkey, 'n' || (s_suppkey * 7), CASE WHEN s_suppkey % 4 = 0 THEN 'd' || (s_suppkey % 40) || '.example' END, NULL, false FROM supplier),
k AS (SELECT id, 'name:' || name AS key FROM r WHERE trim(name) <> '' UNION SELECT id, 'name:' || alias FROM r WHERE trim(name) <> '' AND alias IS NOT NULL UNION SELECT id, 'domain:' || domain FROM r WHERE trim(name) <> '' AND domain IS NOT NULL),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key)),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT t.node, e.b FROM reach t JOIN e ON e.a = t.other),
m AS (SELECT node, count(*) FILTER (WHERE NOT new) AS n, min(other) FILTER (WHERE NOT new) AS known, min(other) AS first, coalesce(min(domain) <> max(domain), false) AS differ FROM (SELECT DISTINCT node, other FROM reach) JOIN r ON r.id = other GROUP BY node),
o AS (SELECT r.id, m.*, CASE WHEN trim(name) = '' THEN 'INVALID' WHEN n > 1 THEN 'AMBIGUOUS' WHEN differ THEN 'DOMAIN' WHEN n = 1 THEN 'MATCHED' ELSE 'CREATED' END AS outcome FROM r LEFT JOIN m ON node = r.id WHERE new)
SELECT id AS candidate, CASE outcome WHEN 'MATCHED' THEN known WHEN 'CREATED' THEN first END AS company, outcome FROM o""")
def reconciled_companies(spark, sf_dir):
    """Each candidate's one company by name, domain and aliases, by chains too; several companies or domains are an outcome, not a guess."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("n"), F.floor(x).cast("string"))
    domain = lambda x: F.concat(F.lit("d"), (x % 40).cast("string"), F.lit(".example"))
    candidates = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 29 == 0, " ").otherwise(name(k / 2)).alias("name"), F.when(k % 3 == 0, domain(k)).alias("domain"), F.when(k % 7 == 0, F.array(name(k / 2 + 1))).alias("aliases"))
    companies = table(spark, sf_dir, "supplier").select((-1 - s).alias("id"), name(s * 7).alias("name"), F.when(s % 4 == 0, domain(s)).alias("domain"), F.lit(None).cast("array<string>").alias("aliases"))
    return E.reconciled(candidates, companies)


@query("""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type IN ('error', 'signup') AS low, CASE WHEN event_type = 'error' THEN value * 3600 END AS retry FROM events),
s AS (SELECT user_id, event_id, k, epoch_us(ts) AS w, CAST(1 AS BIGINT) AS used, CASE WHEN retry IS NULL THEN 0 ELSE epoch_us(ts) + CAST(trunc(retry * 1000000) AS BIGINT) END AS until, 'TAKEN' AS decision FROM r WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, w, CASE WHEN d = 'TAKEN' THEN used + 1 ELSE used END, CASE WHEN d = 'TAKEN' AND retry IS NOT NULL THEN t + CAST(trunc(retry * 1000000) AS BIGINT) ELSE until END, d FROM (
    SELECT *, CASE WHEN t < until THEN 'COOLDOWN' WHEN used >= CASE WHEN low THEN 4 ELSE 3 END THEN 'BUDGET' ELSE 'TAKEN' END AS d FROM (
      SELECT r.user_id, r.event_id, r.k, r.low, r.retry, epoch_us(r.ts) AS t, s.until, CASE WHEN epoch_us(r.ts) - s.w >= 5 * 86400 * 1000000::BIGINT THEN epoch_us(r.ts) ELSE s.w END AS w, CASE WHEN epoch_us(r.ts) - s.w >= 5 * 86400 * 1000000::BIGINT THEN 0 ELSE s.used END AS used
      FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS host, event_id AS request, decision, used FROM s""")
def admitted_requests(spark, sf_dir):
    """Which requests a host's budget lets through: windows that open with a request, a reserve for low yield, cooldowns that answers ask for."""
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("request"), F.col("ts").alias("at"), F.col("event_type").isin("error", "signup").alias("low_yield"), F.when(F.col("event_type") == "error", F.col("value") * 3600).alias("retry_after_s"))
    return keyed.admitted(requests, keyed.Budget(4, 5 * 86_400, 0.25))


def cache_operations(spark, sf_dir):
    """Events as reads and writes of a cache; every ninth write was made six hours before it came."""
    rows, put = table(spark, sf_dir, "events"), F.col("event_type").isin("purchase", "signup", "error")
    late = F.col("ts") - F.expr("INTERVAL '6' HOUR")
    return rows.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("url"), F.col("event_id").alias("seq"), F.when(put & (F.col("event_id") % 9 == 0), late).otherwise(F.col("ts")).alias("at"), F.when(put, "put").otherwise("get").alias("op"), F.when(put, F.col("props")).alias("content"))


@query("""
WITH o AS (SELECT sha256('u' || user_id % 50) AS url_hash, event_id AS seq, event_type IN ('purchase', 'signup', 'error') AS put, epoch_us(ts) - CASE WHEN event_type IN ('purchase', 'signup', 'error') AND event_id % 9 = 0 THEN 6 * 3600 * 1000000::BIGINT ELSE 0 END AS t, props FROM events),
l AS (SELECT *, max(CASE WHEN put THEN {'t': t, 'seq': seq, 'c': props} END) OVER (PARTITION BY url_hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o)
SELECT url_hash, seq, coalesce(t < last.t + 4 * 3600 * 1000000::BIGINT, false) AS hit, CASE WHEN t < last.t + 4 * 3600 * 1000000::BIGINT THEN last.c END AS content FROM l WHERE NOT put""")
def cached_reads(spark, sf_dir):
    """What each read of a cache finds: the write made last of those that came before, while it holds."""
    return keyed.cache_reads(cache_operations(spark, sf_dir), 4 * 3600)
