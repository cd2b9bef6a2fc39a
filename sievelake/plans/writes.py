"""The write path as plans: what a batch's items become, what is merged, refreshed, decided, gated and counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import classify, dates, money
from sievelake.functions import predicates as P
from sievelake.operators import resolution as R
from sievelake.operators import state as S
from sievelake.plans.base import at, query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


CUT = "2023-12-15 00:00:00"


@query(f"""
WITH b AS (SELECT event_id, user_id AS i, event_type AS p, CAST(floor(value / 10) AS BIGINT) AS s, ts, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 40 DAY END AS published, CASE WHEN event_id % 4 = 1 THEN ts - INTERVAL 60 DAY END AS updated, event_id % 13 = 0 AS off FROM events WHERE event_id % 2 = 1),
k AS (SELECT DISTINCT user_id AS i, event_type AS p, CAST(floor(value / 10) AS BIGINT) AS s FROM events WHERE event_id % 10 = 0), f AS (SELECT user_id AS i, min(ts) AS first FROM events WHERE event_id % 10 = 0 GROUP BY 1),
plain AS (SELECT b.*, CASE WHEN k.i IS NOT NULL THEN 'OBSERVED' WHEN off THEN 'SKIPPED' WHEN coalesce(published, CASE WHEN updated < TIMESTAMP '{CUT}' THEN updated END, first) < TIMESTAMP '{CUT}' THEN 'STALE' ELSE 'NEW' END AS o FROM b LEFT JOIN k USING (i, p, s) LEFT JOIN f USING (i))
SELECT event_id, CASE WHEN max(CASE WHEN o = 'NEW' THEN 1 ELSE 0 END) OVER (PARTITION BY i, p, s ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'OBSERVED' ELSE o END AS outcome FROM plain""")
def ingest_outcomes(spark, sf_dir):
    """What becomes of each item of a batch: observed before, not wanted, stale, or new evidence."""
    key, ts = F.col("event_id"), F.col("ts")
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").alias("identity"), F.col("event_type").alias("payload_hash"), F.floor(F.col("value") / 10).alias("semantic_hash"), "ts")
    batch = rows.where(key % 2 == 1).select(
        "*", ts.alias("fetched_at"), key.alias("ordinal"), F.when(key % 3 == 0, ts - F.expr("INTERVAL '40' DAY")).alias("published_at"), F.when(key % 4 == 1, ts - F.expr("INTERVAL '60' DAY")).alias("updated_at"), (key % 13 == 0).alias("off_target"),
    )
    return S.ingest(batch, rows.where(key % 10 == 0).withColumn("stored_at", ts), at(CUT)).select("event_id", "outcome")


@query("""SELECT l_orderkey AS identity, greatest(min(l_shipdate), max(l_shipdate) FILTER (WHERE l_returnflag = 'R')) AS last_seen FROM lineitem GROUP BY 1""")
def presence_forward(spark, sf_dir):
    """A sighting moves an occurrence's date forward, never back."""
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("identity"), "l_shipdate", "l_returnflag")
    known = rows.groupBy("identity").agg(F.min("l_shipdate").alias("last_seen"))
    return S.presence(known, rows.where("l_returnflag = 'R'").withColumnRenamed("l_shipdate", "seen_at"))


@query("""SELECT event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS cosmetic FROM events""")
def cosmetic_versions(spark, sf_dir):
    """Versions that mean what the one before them meant."""
    return S.cosmetic(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "cosmetic")


@query("""
WITH r AS (SELECT l_suppkey, max(l_shipdate) AS run FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
g AS (SELECT l_orderkey AS posting_id, bool_and(coalesce(l_shipdate < run - INTERVAL 24 HOUR, false)) AS gone, CASE WHEN l_orderkey % 5 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM lineitem LEFT JOIN r USING (l_suppkey) GROUP BY l_orderkey)
SELECT posting_id, CASE WHEN gone THEN 'CLOSED' WHEN status = 'CLOSED' THEN 'ACTIVE' ELSE status END AS status FROM g""")
def reconciled_status(spark, sf_dir):
    """Closed once every source has run in full since, without it; open again as soon as one sees it."""
    lines = items(spark, sf_dir)
    seen = lines.select(F.col("l_orderkey").alias("posting_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("last_seen"), F.when(F.col("l_orderkey") % 5 == 0, "CLOSED").otherwise("ACTIVE").alias("status"))
    return S.reconcile(seen, lines.select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("started_at"), (F.col("l_linestatus") == "F").alias("complete")))


STATES = ("SAVED", "APPLIED", "SCREENING", "INTERVIEW", "OFFER", "ACCEPTED", "REJECTED", "WITHDRAWN")


@query("""
WITH m AS (SELECT event_id, ['SAVED', 'APPLIED', 'SCREENING', 'INTERVIEW', 'OFFER', 'ACCEPTED', 'REJECTED', 'WITHDRAWN'][event_id % 8 + 1] AS a, ['SAVED', 'APPLIED', 'SCREENING', 'INTERVIEW', 'OFFER', 'ACCEPTED', 'REJECTED', 'WITHDRAWN'][user_id % 8 + 1] AS b FROM events)
SELECT event_id, a IN ('SAVED', 'APPLIED', 'SCREENING', 'INTERVIEW', 'OFFER') AND (b = 'WITHDRAWN' OR (a <> 'SAVED' AND b = 'REJECTED') OR (a, b) IN (('SAVED', 'APPLIED'), ('APPLIED', 'SCREENING'), ('SCREENING', 'INTERVIEW'), ('INTERVIEW', 'OFFER'), ('OFFER', 'ACCEPTED'))) AS allowed FROM m""")
def application_moves(spark, sf_dir):
    """Which moves of an application's state are allowed."""
    state = lambda k: F.element_at(F.array(*map(F.lit, STATES)), (k % 8 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", S.allowed(S.APPLICATION_MOVES, state(F.col("event_id")), state(F.col("user_id"))).alias("allowed"))


@query("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def pointer_upsert(spark, sf_dir):
    """The newest of each key over what is stored and what has come."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    return S.pointer(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), ["user_id"], ["ts", "event_id"])


@query("""
WITH s AS (SELECT p_partkey, p_type AS level, p_name AS name, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * p_size AS u FROM part),
c AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'OTHER' END AS level, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN NULL ELSE upper(p_name) END AS name, TIMESTAMP '2024-01-25' AS u FROM part WHERE p_partkey % 2 = 0),
v AS (SELECT s.*, c.p_partkey IS NOT NULL AS m, c.p_partkey IS NOT NULL AND c.u >= s.u AS fresh, c.level AS cl, c.name AS cn, c.u AS cu FROM s LEFT JOIN c USING (p_partkey)),
n AS (SELECT p_partkey, CASE WHEN m THEN cl ELSE level END AS level, CASE WHEN fresh AND cn <> '' THEN cn ELSE name END AS name, CASE WHEN fresh THEN cu ELSE u END AS updated_at, level AS old_level, name AS old_name FROM v)
SELECT p_partkey, level, name, updated_at, level <> old_level OR name <> old_name AS changed, CAST(1 + CASE WHEN level <> old_level OR name <> old_name THEN 1 ELSE 0 END AS INTEGER) AS version FROM n""")
def refreshed_fields(spark, sf_dir):
    """Rule fields follow the candidate; evidence fields do if it is no older and not empty."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    stored = part.select(key, F.col("p_type").alias("level"), F.col("p_name").alias("name"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(p_size)").alias("updated_at"), F.lit(1).alias("version"))
    name = F.when(key % 4 == 0, F.lit("")).when(key % 6 == 0, F.lit(None)).otherwise(F.upper("p_name"))
    new = part.where(key % 2 == 0).select(key, F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("OTHER").alias("level"), name.alias("name"), at("2024-01-25 00:00:00").alias("updated_at"))
    return S.refreshed(stored, new, "p_partkey", ["level"], ["name"]).select("p_partkey", "level", "name", "updated_at", "changed", "version")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'old' ELSE CASE WHEN p_retailprice > 1000 THEN 'HIGH' ELSE 'LOW' END END AS band, 'v2' AS version FROM part""")
def recomputed_bands(spark, sf_dir):
    """Derived columns are made anew where their version is another; a second run changes nothing."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.lit("old").alias("band"), F.when(F.col("p_size") % 3 == 0, "v2").when(F.col("p_size") % 3 == 1, "v1").alias("version"))
    band = {"band": F.when(F.col("p_retailprice") > 1000, "HIGH").otherwise("LOW")}
    return S.recomputed(S.recomputed(rows, "version", "v2", band), "version", "v2", band).drop("p_retailprice")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NOT_DUE' WHEN value * 60 < CASE WHEN user_id % 4 > 0 THEN least(60.0 * pow(2, user_id % 4 - 1), 3600.0) ELSE 0.0 END THEN 'BACKOFF' WHEN value * 100 < 3600 THEN 'TOO_SOON' WHEN user_id % 7 - 2 <= 0 THEN 'HOST_BUDGET' ELSE 'RUN' END AS reason FROM events""")
def run_gates(spark, sf_dir):
    """Why a source runs or waits, the first reason in order."""
    found = S.gate(F.col("event_id") % 5 != 0, F.col("user_id") % 4, F.col("value") * 60, F.col("value") * 100, 3600, F.col("user_id") % 7 - 2)
    return events(spark, sf_dir).select("event_id", found.alias("reason"))


@query("""SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS used, CAST(greatest(8 - count(*), 0) AS BIGINT) AS "left" FROM events GROUP BY 1, 2""")
def host_budgets(spark, sf_dir):
    """Requests by host and hour, and what is left of a limit less a reserve."""
    return S.host_budget(events(spark, sf_dir), "user_id", "ts", "1 hour", 10, 2).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "used", "left")


@query("""SELECT o_orderkey, o_orderstatus = 'O' AND NOT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END, false) AND (o_orderkey % 7 = 0 OR o_custkey % 20 >= o_orderkey % 25) AS complete FROM orders""")
def completed_runs(spark, sf_dir):
    """A run is complete if it succeeded, was not capped, and saw all that was announced."""
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").otherwise("FAILED")
    return orders(spark, sf_dir).select("o_orderkey", S.complete(status, F.when(key % 3 > 0, key % 3 == 1), F.col("o_custkey") % 20, F.when(key % 7 > 0, key % 25)).alias("complete"))


@query("""
WITH t AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), o AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS terms FROM t GROUP BY 1)
SELECT user_id, terms, max(value) AS score, arg_max(props, (value, -event_id)) AS excerpt, count(*) AS n_hits FROM events JOIN o USING (user_id) GROUP BY 1, 2""")
def merged_search_hits(spark, sf_dir):
    """Hits of one company as one: terms in order, the best score, the strongest excerpt."""
    hits = events(spark, sf_dir).select("user_id", F.col("event_id").alias("ordinal"), F.col("event_type").alias("term"), F.col("value").alias("score"), F.col("props").alias("excerpt"))
    return S.merged_hits(hits, "user_id").withColumn("terms", F.array_join("terms", ","))


@query("""
WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS t FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS t FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN a.n = 1 THEN a.t WHEN b.n = 1 THEN b.t ELSE c.t END AS target, CASE WHEN a.n = 1 THEN 'identity' WHEN b.n = 1 THEN 'url' ELSE 'fingerprint' END AS level
FROM c LEFT JOIN a USING (l_orderkey) LEFT JOIN b USING (l_orderkey) WHERE a.n = 1 OR b.n = 1 OR c.n = 1""")
def identity_cascade(spark, sf_dir):
    """Each item's match at the first level that has exactly one: its identity, its URL, its fingerprint."""
    lines = items(spark, sf_dir).select("l_orderkey", F.col("l_suppkey").alias("target"), "l_returnflag", "l_linestatus")
    level = lambda where: lines.where(where).select("l_orderkey", "target")
    return R.cascade([("identity", level("l_returnflag = 'R'")), ("url", level("l_linestatus = 'O'")), ("fingerprint", level("true"))], "l_orderkey")


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 3 AS version FROM orders),
p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.version AS a_version, b.version AS b_version FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 14 * 86400 * 1000000::BIGINT)
SELECT * FROM p WHERE NOT (a % 2 = 0 AND a % 4 > 0)""")
def undecided_pairs(spark, sf_dir):
    """Candidates within two weeks, but for those rejected at the same versions; a decision on an older version counts no more."""
    rows = orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 3).alias("version"))
    every = R.candidate_pairs(rows, ["o_custkey"], "o_orderkey", "o_orderdate", 14)
    rejected = every.where("a % 2 = 0").select("a", "b", F.when(F.col("a") % 4 == 0, F.col("a_version") + 1).otherwise(F.col("a_version")).alias("a_version"), "b_version")
    return R.candidate_pairs(rows, ["o_custkey"], "o_orderkey", "o_orderdate", 14, rejected)


@query("""
WITH l AS (SELECT *, CASE l_linestatus WHEN 'F' THEN 'REQUIRED' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'PREFERRED' ELSE 'UNKNOWN' END END AS requirement FROM lineitem)
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, count(DISTINCT l_returnflag) > 1 AS flag_conflict,
  CASE WHEN count(DISTINCT requirement) FILTER (WHERE requirement <> 'UNKNOWN') = 1 THEN min(requirement) FILTER (WHERE requirement <> 'UNKNOWN') ELSE 'UNKNOWN' END AS requirement,
  count(DISTINCT l_quantity) > 1 OR count(DISTINCT l_extendedprice) > 1 OR count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1 OR coalesce(min(l_quantity) > max(l_extendedprice), false) AS pay_conflict FROM l GROUP BY 1""")
def merged_groups(spark, sf_dir):
    """A group's field, requirement and pay: alike is merged, a conflict is told."""
    kind = F.when(F.col("l_linestatus") == "F", "REQUIRED").when(F.col("l_linenumber") % 2 == 0, "PREFERRED").otherwise("UNKNOWN")
    value, conflict = R.merged_field("l_returnflag")
    rows = items(spark, sf_dir).withColumn("requirement", kind).groupBy("l_orderkey")
    return rows.agg(value.alias("flag"), conflict.alias("flag_conflict"), R.merged_requirement("requirement").alias("requirement"), R.compensation_conflict("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").alias("pay_conflict"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['ANY'] WHEN 2 THEN ['BR', 'US'] WHEN 3 THEN ['US'] ELSE ['DE'] END AS countries, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS manual FROM customer)
SELECT c_custkey, countries IS NOT NULL AND NOT list_has_any(countries, ['BR', 'ANY']) AS outside, coalesce(manual, false) OR (c_acctbal > 1000 AND c_mktsegment <> 'BUILDING') AS approved,
  CASE WHEN contains(c_mktsegment, 'HOUSE') AND NOT contains(c_name, '7') THEN 'HOME' WHEN contains(c_name, '7') AND NOT contains(c_mktsegment, 'HOUSE') THEN 'SEVEN' ELSE 'UNKNOWN' END AS class FROM c JOIN customer USING (c_custkey)""")
def null_safe_rules(spark, sf_dir):
    """Places outside of the wanted ones, approval by hand or by all gates, and a class that only one sort of evidence gives."""
    nation, key = F.col("c_nationkey") % 5, F.col("c_custkey")
    countries = F.when(nation == 0, F.lit(None)).when(nation == 1, F.array(F.lit("ANY"))).when(nation == 2, F.array(F.lit("BR"), F.lit("US"))).when(nation == 3, F.array(F.lit("US"))).otherwise(F.array(F.lit("DE")))
    manual = F.when(key % 3 > 0, key % 3 == 1)
    one = P.infer_unique({"HOME": F.col("c_mktsegment").contains("HOUSE"), "SEVEN": F.col("c_name").contains("7")})
    approved = P.homologated(manual, [F.col("c_acctbal") > 1000, F.col("c_mktsegment") != "BUILDING"])
    return table(spark, sf_dir, "customer").select("c_custkey", classify.outside_countries(countries, ["BR"]).alias("outside"), approved.alias("approved"), one.alias("class"))


@query("""
WITH t AS (SELECT p_partkey, CAST(p_retailprice * 10 AS BIGINT) AS n, p_size % 3 AS kind, ['per hour', 'monthly', 'a year or per hour', 'per annum', ''][p_partkey % 5 + 1] AS span, ['gross', 'net', 'gross or net', ''][p_size % 4 + 1] AS basis FROM part)
SELECT p_partkey, CAST(CASE kind WHEN 0 THEN n + 0.25 WHEN 1 THEN n + 0.5 ELSE n * 1000 END AS DOUBLE) AS amount, CASE span WHEN 'per hour' THEN 'HOUR' WHEN 'monthly' THEN 'MONTH' WHEN 'a year or per hour' THEN 'HOUR' WHEN 'per annum' THEN 'YEAR' END AS period, CASE basis WHEN 'gross' THEN 'GROSS' WHEN 'net' THEN 'NET' END AS basis FROM t""")
def amounts_read(spark, sf_dir):
    """Numbers with either decimal mark, with a k for thousands, and what they are for."""
    n = F.round(F.col("p_retailprice") * 10).cast("long")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    english = F.format_number(n, 0)
    said = F.when(F.col("p_size") % 3 == 0, F.concat(english, F.lit(".25"))).when(F.col("p_size") % 3 == 1, F.concat(F.translate(english, ",", "."), F.lit(",50"))).otherwise(F.concat(n.cast("string"), F.lit(" k")))
    span, basis = pick(["per hour", "monthly", "a year or per hour", "per annum", ""], F.col("p_partkey") % 5), pick(["gross", "net", "gross or net", ""], F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", money.money_amount(said).cast("double").alias("amount"), money.period_from_text(span).alias("period"), money.gross_net_from_text(basis).alias("basis"))


@query("""
WITH s AS (SELECT o_custkey AS c_custkey, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS careers, bool_or(o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0) AS board, bool_or(o_orderpriority = '3-MEDIUM' AND o_orderdate >= TIMESTAMP '1997-06-01') AS tried FROM orders GROUP BY 1)
SELECT c_custkey FROM s JOIN customer USING (c_custkey) WHERE careers AND NOT board AND NOT tried""")
def discovery_queue(spark, sf_dir):
    """Companies to look for a board of: careers page confirmed, no board known, not tried of late."""
    rows = orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "careers").when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 4 == 0), "greenhouse").otherwise("other")
    sources = rows.select("c_custkey", kind.alias("source_type"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    attempts = rows.where("o_orderpriority = '3-MEDIUM'").select("c_custkey", F.col("o_orderdate").alias("attempted_at"))
    return S.discovery_eligible(table(spark, sf_dir, "customer"), sources, attempts, "c_custkey", ["greenhouse", "lever"], at("1997-06-01 00:00:00")).select("c_custkey")


@query("""
WITH a AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS t, CASE WHEN event_id % 7 > 0 THEN event_id % 3 = 0 END AS paid FROM events)
SELECT event_id, coalesce(t > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY, false) AND coalesce(paid, false) AS shielded_from_paid, coalesce(t > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY, false) AS shielded_from_free FROM a""")
def retry_guards(spark, sf_dir):
    """Whether an earlier attempt keeps the next one from running; a free one does not keep off a paid one."""
    tried, paid = F.when(F.col("event_id") % 5 > 0, F.col("ts")), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 3 == 0)
    shield = lambda enabled: S.recently_attempted(tried, paid, enabled, at("2024-01-20 00:00:00"), 10)
    return events(spark, sf_dir).select("event_id", shield(True).alias("shielded_from_paid"), shield(False).alias("shielded_from_free"))


@query("""SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def purged_events(spark, sf_dir):
    """What a purge by age leaves."""
    return S.purged(events(spark, sf_dir), "ts", at("2024-01-10 00:00:00")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


@query("""
WITH p AS (SELECT o_orderkey AS id, o_orderdate AS created, o_orderkey % 3 AS version, o_orderkey % 17 = 0 AS absorbed, o_orderstatus = 'P' AS active, o_custkey FROM orders),
c AS (SELECT a.id AS a, b.id AS b, a.created AS ca, b.created AS cb, CASE WHEN a.id % 5 = 0 THEN 'REJECTED' ELSE 'PENDING' END AS status, a.id % 7 > 0 AS same, a.absorbed OR b.absorbed AS cycle, a.active AND b.active AS two
  FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.id < b.id AND abs(epoch_us(a.created) - epoch_us(b.created)) <= 30 * 86400 * 1000000::BIGINT),
r AS (SELECT *, CASE WHEN status <> 'PENDING' THEN status WHEN NOT same THEN 'VERSION' WHEN cycle THEN 'CYCLE' WHEN two THEN 'CONFLICT' END AS refused FROM c),
f AS (SELECT side, min((a, b)) AS first FROM (SELECT a AS side, a, b FROM r WHERE refused IS NULL UNION ALL SELECT b, a, b FROM r WHERE refused IS NULL) GROUP BY 1),
o AS (SELECT r.*, coalesce(refused, CASE WHEN x.first = (r.a, r.b) AND y.first = (r.a, r.b) THEN 'CONFIRM' ELSE 'LATER' END) AS outcome FROM r LEFT JOIN f x ON x.side = r.a LEFT JOIN f y ON y.side = r.b)
SELECT a, b, outcome, CASE WHEN outcome = 'CONFIRM' THEN CASE WHEN (ca, a) <= (cb, b) THEN a ELSE b END END AS survivor, CASE WHEN outcome = 'CONFIRM' THEN CASE WHEN (ca, a) <= (cb, b) THEN b ELSE a END END AS absorbed FROM o""")
def confirmed_merges(spark, sf_dir):
    """Which confirmations of a batch go through, and why the others don't."""
    rows = orders(spark, sf_dir).withColumn("version", F.col("o_orderkey") % 3)
    pairs = R.candidate_pairs(rows.select("o_custkey", "o_orderkey", "o_orderdate", "version"), ["o_custkey"], "o_orderkey", "o_orderdate", 30)
    candidates = pairs.withColumns({"status": F.when(F.col("a") % 5 == 0, "REJECTED").otherwise("PENDING"), "a_version": F.when(F.col("a") % 7 > 0, F.col("a_version")).otherwise(F.col("a_version") + 1)})
    postings = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), "version", F.when(F.col("o_orderkey") % 17 == 0, F.lit(-1)).alias("duplicate_of"))
    return S.confirmed_merges(candidates, postings, orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@query("""
WITH g AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1), c AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(last_ts)) / 1000000.0 AS age, CASE user_id % 4 WHEN 0 THEN 1800.0 WHEN 1 THEN 21600.0 WHEN 2 THEN 86400.0 ELSE 604800.0 END AS cadence FROM g)
SELECT user_id, round(age, 3) AS age_s, CAST(cadence AS DOUBLE) AS cadence_s, round(age / cadence, 6) AS overdue FROM c WHERE age > 2 * cadence""")
def scheduled_gaps(spark, sf_dir):
    """Sources unseen for more than twice what their schedule allows."""
    schedule = F.element_at(F.array(*map(F.lit, ("*/30 * * * *", "0 */6 * * *", "15 3 * * *", "0 9 * * 1"))), (F.col("user_id") % 4 + 1).cast("int"))
    seen = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_ts")).withColumn("cadence_s", dates.cadence_seconds(schedule))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(at("2024-01-20 00:00:00")) - micros(F.col("last_ts"))) / 1e6
    return seen.withColumn("age", age).where("age > 2 * cadence_s").select("user_id", F.round("age", 3).alias("age_s"), "cadence_s", F.round(F.col("age") / F.col("cadence_s"), 6).alias("overdue"))
