"""The catalogue: inbox pages, filters, existence, windows and sets. Orders stand in for postings, customers for companies,
suppliers for sources, line items for occurrences and pay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import predicates as P
from sievelake.operators import aggregates as A
from sievelake.operators import joins as J
from sievelake.operators.latest import folded, latest_by, page, seeded_sample, value_queue, with_totals
from sievelake.plans.base import at, long, query, table

NOW, CUTOFF = "1998-08-02 00:00:00", "1996-01-01 00:00:00"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


INBOX_SQL = """
WITH first_source AS (SELECT l_orderkey, min(l_suppkey) AS source FROM lineitem GROUP BY 1),
rows AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority, f.source, o.o_orderstatus = 'O' AS in_area
  FROM orders o LEFT JOIN first_source f ON f.l_orderkey = o.o_orderkey WHERE o.o_orderstatus <> 'P'),
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey, in_area) - 1 AS sibling_count FROM rows
  WINDOW w AS (PARTITION BY o_custkey, in_area ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, o_totalprice DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey)),
totals AS (SELECT count(*) FILTER (WHERE in_area) AS total, count(*) FILTER (WHERE NOT in_area) AS off_filter FROM ranked WHERE rn = 1)
"""


def inbox_rows(spark, sf_dir):
    """Postings that are not closed, each in or out of the wanted area; folded to the best of each company and area."""
    rows = orders(spark, sf_dir).where(F.col("o_orderstatus") != "P").withColumn("in_area", F.col("o_orderstatus") == "O")
    return folded(rows, ["o_custkey", "in_area"], inbox_order())


def inbox_order():
    tier = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1)
    return tier, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")


@query(INBOX_SQL + """
SELECT r.o_orderkey, r.o_orderpriority, r.o_totalprice, CAST(r.sibling_count AS BIGINT) AS sibling_count, c.c_name, n.n_name, r.source, t.total, t.off_filter
FROM (SELECT * FROM ranked WHERE rn = 1 AND in_area ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, o_totalprice DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20) r
JOIN customer c ON c.c_custkey = r.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey CROSS JOIN totals t""")
def inbox_page(spark, sf_dir):
    """A page of folded postings with its totals. Names and sources are looked up for the page's rows only."""
    best = inbox_rows(spark, sf_dir)
    totals = best.agg(F.count_if("in_area").alias("total"), F.count_if(~F.col("in_area")).alias("off_filter"))
    shown = page(best.where("in_area"), inbox_order(), 20, 20)
    source = items(spark, sf_dir).join(shown.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("source"))
    named = shown.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(source, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return with_totals(named, totals).select("o_orderkey", "o_orderpriority", "o_totalprice", "sibling_count", "c_name", "n_name", "source", "total", "off_filter")


@query(INBOX_SQL + "SELECT * FROM totals")
def inbox_totals(spark, sf_dir):
    """The totals alone, as an empty page needs them."""
    return inbox_rows(spark, sf_dir).agg(F.count_if("in_area").alias("total"), F.count_if(~F.col("in_area")).alias("off_filter"))


@query("""
SELECT query, n FROM (
SELECT 'urgent' AS query, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT 'large', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 200000 UNION ALL
SELECT 'recent', count(DISTINCT o_custkey) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL
SELECT 'open_large', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000)""")
def saved_search_counts(spark, sf_dir):
    """How many companies each saved search finds, all in one pass."""
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    searches = {"urgent": F.col("o_orderpriority") == "1-URGENT", "large": price > 200000, "recent": date >= at("1997-01-01 00:00:00"), "open_large": (F.col("o_orderstatus") == "O") & (price > 100000)}
    return A.batch_counts(orders(spark, sf_dir), "o_custkey", searches)


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 35 THEN ['ANY'] ELSE [split_part(p_type, ' ', 1), split_part(p_type, ' ', 3)] END AS tags FROM part)
SELECT p_partkey FROM p WHERE tags IS NULL OR list_has_any(tags, ['STANDARD', 'BRASS', 'ANY'])""")
def unknown_keeps(spark, sf_dir):
    """A filter on an array keeps rows whose array is unknown."""
    words = F.split("p_type", " ")
    tags = F.when(F.col("p_size") > 40, F.lit(None)).when(F.col("p_size") > 35, F.array(F.lit("ANY"))).otherwise(F.array(F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(2)), F.lit(""))))
    return table(spark, sf_dir, "part").where(P.member_or_unknown(tags, ["STANDARD", "BRASS"])).select("p_partkey")


@query("""
WITH pay AS (SELECT l_orderkey, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_extendedprice END AS low, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_extendedprice * 1.2 END AS high, l_returnflag AS currency FROM lineitem),
known AS (SELECT DISTINCT l_orderkey FROM pay WHERE low IS NOT NULL OR high IS NOT NULL),
fit AS (SELECT DISTINCT l_orderkey FROM pay WHERE currency = 'N' AND (low IS NOT NULL OR high IS NOT NULL) AND (high IS NULL OR high >= 30000) AND (low IS NULL OR low <= 40000))
SELECT o_orderkey, CASE WHEN f.l_orderkey IS NOT NULL THEN 'matched' ELSE 'unknown' END AS label FROM orders LEFT JOIN fit f ON f.l_orderkey = o_orderkey LEFT JOIN known k ON k.l_orderkey = o_orderkey WHERE f.l_orderkey IS NOT NULL OR k.l_orderkey IS NULL""")
def salary_range(spark, sf_dir):
    """Pay in the wanted range, in the same currency; postings without any known pay are kept and labelled."""
    low = F.when(F.col("l_discount") <= 0.08, F.col("l_extendedprice"))
    high = F.when(F.col("l_tax") <= 0.06, F.col("l_extendedprice") * 1.2)
    pay = items(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), low.alias("low"), high.alias("high"), F.col("l_returnflag").alias("currency")).where("low is not null or high is not null")
    fit = pay.where((F.col("currency") == "N") & J.overlaps(F.col("low"), F.col("high"), F.lit(30000), F.lit(40000)))
    marked = J.with_flag(J.with_flag(orders(spark, sf_dir), fit, ["o_orderkey"], "fits"), pay, ["o_orderkey"], "known")
    return marked.where("fits or not known").select("o_orderkey", F.when(F.col("fits"), "matched").otherwise("unknown").alias("label"))


@query(f"""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS updated, o_orderdate - INTERVAL 2 DAY AS first_seen,
  o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 AS exempt, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS valid_through FROM orders),
e AS (SELECT *, coalesce(published, updated, first_seen) AS effective, CASE WHEN published IS NOT NULL THEN 'published' WHEN updated IS NOT NULL THEN 'updated' ELSE 'first_seen' END AS basis FROM d)
SELECT o_orderkey, effective, basis, basis <> 'published' AS estimated, effective >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR exempt OR coalesce(valid_through > TIMESTAMP '{NOW}', false) AS visible FROM e""")
def recency_decisions(spark, sf_dir):
    """Whether a posting still shows, by which of its dates."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    decision = P.recency_decision(
        F.when(key % 3 == 0, date), F.when(key % 5 == 0, date + F.expr("INTERVAL '5' DAY")), date - F.expr("INTERVAL '2' DAY"),
        (F.col("o_orderpriority") == "5-LOW") & (key % 7 == 0), F.when(key % 11 == 0, date + F.expr("INTERVAL '90' DAY")), at(NOW),
    )
    return orders(spark, sf_dir).select("o_orderkey", decision.alias("d")).select("o_orderkey", "d.effective", "d.basis", "d.estimated", "d.visible")


@query("""SELECT o_orderkey, CASE WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') < 0 THEN NULL WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') <= 3 THEN 0 WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') <= 7 THEN 1
WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') <= 14 THEN 2 WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') <= 30 THEN 3 ELSE 4 END AS band FROM orders""")
def recency_bands(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", P.recency_band(F.col("o_orderdate"), at(NOW)).alias("band"))


@query("""
WITH latest AS (SELECT l_suppkey, l_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_linestatus = 'F') WHERE rn = 1)
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem l JOIN latest t ON t.l_suppkey = l.l_suppkey AND t.run = l.l_orderkey WHERE l.l_orderkey = o_orderkey)""")
def open_at_source(spark, sf_dir):
    """Postings seen by the newest complete run of one of their own sources."""
    lines = items(spark, sf_dir)
    newest = latest_by(lines.where("l_linestatus = 'F'"), ["l_suppkey"], [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()]).select("l_suppkey", "l_orderkey")
    seen = lines.join(newest, ["l_suppkey", "l_orderkey"], "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, sf_dir).join(seen, "o_orderkey", "left_semi").select("o_orderkey")


@query("""
SELECT p_partkey, coalesce(list_has_any(string_split(p_type, ' '), ['PROMO', 'TIN']) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 20, false) AS off_target FROM part""")
def off_target(spark, sf_dir):
    """A null-safe condition over arrays, lists and numbers."""
    found = F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("PROMO"), F.lit("TIN"))) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & (F.col("p_size") > 20)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(found, F.lit(False)).alias("off_target"))


@query("""SELECT o_orderkey FROM orders WHERE (lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%not spec%') AND o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('O', 'F')""")
def dynamic_filters(spark, sf_dir):
    """The conjunction of those filters that are set."""
    unset = None
    wanted = P.all_of([P.contains_any(F.col("o_orderpriority"), ["Urgent", "not spec"]), F.col("o_totalprice").between(50000, 150000), F.col("o_orderstatus").isin("O", "F"), unset])
    return orders(spark, sf_dir).where(wanted).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def pending_normalisations(spark, sf_dir):
    """Items without a result of the current version: an anti join on both keys."""
    done = orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 10 = 3)""")
def from_source(spark, sf_dir):
    """A source filter that never doubles a row."""
    wanted = items(spark, sf_dir).where("l_suppkey % 10 = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, sf_dir).join(wanted, "o_orderkey", "left_semi").select("o_orderkey")


@query("""
WITH pairs AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 50)
SELECT p_partkey, EXISTS (SELECT 1 FROM pairs WHERE a = p_partkey OR b = p_partkey) AS pending FROM part""")
def pending_duplicates(spark, sf_dir):
    """Whether a posting is on either side of a pair."""
    pairs = items(spark, sf_dir).where("l_quantity = 50").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return J.either_side(table(spark, sf_dir, "part"), "p_partkey", pairs, "a", "b", "pending").select("p_partkey", "pending")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1998-06-01')
AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1997-01-01') < 3""")
def analysis_queue(spark, sf_dir):
    """No finished analysis, no cool-down, and fewer than three attempts in the window."""
    tried = orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    attempts = tried.where(F.col("o_orderdate") > at("1997-01-01 00:00:00")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("attempts"))
    waiting = table(spark, sf_dir, "customer").join(tried.where("o_orderstatus = 'F'"), "c_custkey", "left_anti").join(tried.where(F.col("o_orderdate") > at("1998-06-01 00:00:00")), "c_custkey", "left_anti")
    return waiting.join(attempts, "c_custkey", "left").where(F.coalesce("attempts", F.lit(0)) < 3).select("c_custkey")


@query("""SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey))""")
def not_superseded(spark, sf_dir):
    """The newest of each key, by time and id: as a window, not as an anti join of all pairs."""
    return latest_by(orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey")


@query(f"""SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate < TIMESTAMP '{CUTOFF}')""")
def superseded_before(spark, sf_dir):
    """Rows with a newer one that is itself older than the cutoff."""
    before = F.max(F.when(F.col("o_orderdate") < at(CUTOFF), F.col("o_orderdate"))).over(Window.partitionBy("o_custkey"))
    return orders(spark, sf_dir).withColumn("last_before", before).where("last_before > o_orderdate").select("o_orderkey")


@query(f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_orderkey FROM ranked r WHERE rn > 1 AND o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def retention_eligible(spark, sf_dir):
    """Old, superseded and unprotected rows, that may go."""
    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    old = orders(spark, sf_dir).withColumn("rank", F.row_number().over(newest)).where((F.col("rank") > 1) & (F.col("o_orderdate") < at(CUTOFF)) & (F.col("o_orderpriority") != "1-URGENT"))
    kept = items(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return old.join(kept, "o_orderkey", "left_anti").select("o_orderkey")


@query("""
WITH s AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS strong, bool_or(o_orderpriority = '5-LOW') AS weak, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority = '1-URGENT') AS batch FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN strong THEN 'strong' WHEN weak THEN 'weak' END AS strength, batch FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def company_strength(spark, sf_dir):
    """The strongest evidence of each company, and the latest of the strong."""
    strong, weak = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    found = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(strong).alias("strong"), F.bool_or(weak).alias("weak"), F.max(F.when(strong, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias("batch"))
    return table(spark, sf_dir, "customer").join(found, "c_custkey", "left").select("c_custkey", F.when(F.col("strong"), "strong").when(F.col("weak"), "weak").alias("strength"), "batch")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND (o_orderstatus, o_orderpriority) IN (('O', '1-URGENT'), ('F', '5-LOW'), ('F', '2-HIGH'))""")
def in_and_not_in(spark, sf_dir):
    """IN as a semi join, NOT IN over keys that are never null as an anti join, a list of pairs as a join."""
    paid = items(spark, sf_dir).where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    pairs = spark.createDataFrame([("O", "1-URGENT"), ("F", "5-LOW"), ("F", "2-HIGH")], "o_orderstatus string, o_orderpriority string")
    return orders(spark, sf_dir).join(paid, "o_orderkey", "left_semi").join(debtors, "o_custkey", "left_anti").join(pairs, ["o_orderstatus", "o_orderpriority"], "left_semi").select("o_orderkey")


@query("""
WITH active AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 1)
SELECT c.c_custkey FROM customer c, active a WHERE c.c_mktsegment = a.c_mktsegment""")
def active_profile(spark, sf_dir):
    """A one-row parameter beside every row."""
    customers = table(spark, sf_dir, "customer")
    active = customers.where("c_acctbal > 0").orderBy("c_custkey").limit(1).select(F.col("c_mktsegment"))
    return customers.join(F.broadcast(active), "c_mktsegment").select("c_custkey")  # active: one row


@query("""SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def key_chain(spark, sf_dir):
    """Outer joins along a chain of keys."""
    near = table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return suppliers.join(near, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS id, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey FROM s LEFT JOIN nation a ON a.n_nationkey = s.id LEFT JOIN nation b ON b.n_name = s.name""")
def name_fallback(spark, sf_dir):
    """By key where there is one, else by name."""
    nation = table(spark, sf_dir, "nation")
    sources = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_nationkey")).alias("n_nationkey"), "n_name")
    return J.name_fallback(sources, nation, nation, "n_nationkey", "n_name", "n_regionkey").select("s_suppkey", "n_regionkey")


@query("""SELECT l_orderkey AS o_orderkey, count(*) AS n_children, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1""")
def nested_children(spark, sf_dir):
    """A posting's children, nested and in order."""
    nested = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("children"))
    return nested.select("o_orderkey", F.size("children").cast("long").alias("n_children"), F.array_join(F.col("children")["l_linenumber"].cast("array<string>"), ",").alias("lines"))


@query("""SELECT a.o_orderkey, count(b.o_orderkey) AS siblings, min(b.o_orderkey) AS first_sibling FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderkey <> a.o_orderkey GROUP BY 1""")
def group_siblings(spark, sf_dir):
    """The others of a group, by a window: no self join."""
    rows = orders(spark, sf_dir)
    by = Window.partitionBy("o_custkey", "o_orderpriority")
    first = F.min("o_orderkey").over(by)
    second = F.min(F.when(F.col("o_orderkey") != F.col("_first"), F.col("o_orderkey"))).over(by)
    return rows.withColumns({"_first": first, "siblings": F.count(F.lit(1)).over(by) - 1}).withColumn("_second", second).select("o_orderkey", "siblings", F.when(F.col("o_orderkey") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("first_sibling"))


@query("""
WITH f AS (SELECT c_custkey, c_acctbal > 0 AS enabled, count(o_orderkey) > 0 AS collected, bool_or(o_orderdate > TIMESTAMP '1997-06-01') AS recent, bool_or(o_orderstatus = 'F') AS normalised FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT count(*) AS catalogue, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE enabled AND collected) AS collected, count(*) FILTER (WHERE enabled AND collected AND normalised) AS normalised, count(*) FILTER (WHERE enabled AND collected AND normalised AND recent) AS collected_recently FROM f""")
def coverage_funnel(spark, sf_dir):
    """How many companies reach each stage, in one pass over flags."""
    flags = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("has"), F.bool_or(F.col("o_orderdate") > at("1997-06-01 00:00:00")).alias("recent"), F.bool_or(F.col("o_orderstatus") == "F").alias("ended"))
    rows = table(spark, sf_dir, "customer").join(flags, "c_custkey", "left")
    return A.funnel(rows, [("catalogue", F.lit(True)), ("enabled", F.col("c_acctbal") > 0), ("collected", F.col("has")), ("normalised", F.col("ended")), ("collected_recently", F.col("recent"))])


@query("""
WITH f AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS c, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority < '3') AS d FROM orders)
SELECT a AS stored, b AS open, c AS eligible, d AS recommended, a - b AS dropped_closed, round(CAST(d AS DOUBLE) / nullif(a, 0), 6) AS kept FROM f""")
def posting_funnel(spark, sf_dir):
    """Cumulative conditions, what each drops, and what is left."""
    counts = A.funnel(orders(spark, sf_dir), [("stored", F.lit(True)), ("open", F.col("o_orderstatus") == "O"), ("eligible", F.col("o_totalprice") > 100000), ("recommended", F.col("o_orderpriority") < "3")])
    return counts.withColumns({"dropped_closed": F.col("stored") - F.col("open"), "kept": A.rate(F.col("recommended"), F.col("stored"))})


@query("""
SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_companies, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-07-01') AS n_new, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders""")
def overview(spark, sf_dir):
    """A dozen counts, in one pass."""
    return orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_companies"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(F.col("o_orderdate") >= at("1998-07-01 00:00:00")).alias("n_new"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
    )


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_returnflag, n, round(n * 100.0 / sum(n) OVER (PARTITION BY l_suppkey), 2) AS pct FROM c""")
def level_distribution(spark, sf_dir):
    """Shares by source, in per cent."""
    return A.distribution(items(spark, sf_dir), ["l_suppkey"], "l_returnflag").withColumn("pct", F.col("pct").cast("double"))


@query("""SELECT s_nationkey, l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def occurrences_by_source(spark, sf_dir):
    return items(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_discount >= 0.05) WHERE rn = 1""")
def top_factors(spark, sf_dir):
    """The strongest factor that was met."""
    return latest_by(items(spark, sf_dir).where("l_discount >= 0.05"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderpriority = '5-LOW'""")
def negative_marks(spark, sf_dir):
    """The newest mark first, and only then whether it is negative."""
    return latest_by(orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).where("o_orderpriority = '5-LOW'").select("o_custkey", "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_shipdate, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def primary_occurrence(spark, sf_dir):
    """The oldest that is open, else the oldest."""
    return latest_by(items(spark, sf_dir), ["l_orderkey"], [F.col("l_linestatus") != "O", F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber")


@query("""
WITH q AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O'), top AS (SELECT * FROM q ORDER BY o_totalprice DESC, o_orderkey LIMIT 40),
rest AS (SELECT * FROM q WHERE o_orderkey NOT IN (SELECT o_orderkey FROM top) ORDER BY o_orderkey LIMIT 10)
SELECT o_orderkey, 'value' AS lane FROM top UNION ALL SELECT o_orderkey, 'aging' FROM rest""")
def value_queue_with_reserve(spark, sf_dir):
    """The most valuable, and some of those that wait longest."""
    waiting = orders(spark, sf_dir).where("o_orderstatus = 'O'")
    return value_queue(waiting, [F.col("o_totalprice").desc(), F.col("o_orderkey")], [F.col("o_orderkey")], 50, 10, "o_orderkey").select("o_orderkey", "lane")


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey, round((CASE WHEN last IS NULL THEN 1e9 ELSE (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(last)) / 1000000.0 END) * CASE c_mktsegment WHEN 'BUILDING' THEN 2.0 ELSE 1.0 END, 3) AS weight FROM customer LEFT JOIN l ON o_custkey = c_custkey ORDER BY weight DESC, c_custkey LIMIT 100""")
def staleness_order(spark, sf_dir):
    """The longest unseen first, by weight; what was never seen counts as very old."""
    last = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    age = F.when(F.col("last").isNull(), 1e9).otherwise(seconds(at(NOW)) - seconds(F.col("last")))
    weight = F.round(age * F.when(F.col("c_mktsegment") == "BUILDING", 2.0).otherwise(1.0), 3)
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", weight.alias("weight")).orderBy(F.col("weight").desc(), "c_custkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50")
def sample_for_review(spark, sf_dir):
    """A seeded sample for human review: a sample is what it is for."""
    return seeded_sample(orders(spark, sf_dir), "o_orderkey", 7, 50).select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%3%' ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def like_ranked(spark, sf_dir):
    """A plain substring search, newest first."""
    found = table(spark, sf_dir, "part").where(F.lower("p_name").contains("a") | F.lower("p_brand").contains("3"))
    return page(found, [F.col("p_retailprice").desc(), F.col("p_partkey")], 10).select("p_partkey")


@query("""SELECT l_orderkey AS id FROM lineitem WHERE l_quantity = 50 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000""")
def referenced_ids(spark, sf_dir):
    """Ids that any of the tables refers to."""
    return items(spark, sf_dir).where("l_quantity = 50").select(F.col("l_orderkey").alias("id")).union(orders(spark, sf_dir).where("o_totalprice > 300000").select("o_orderkey")).distinct()


@query("""SELECT id, kind FROM (SELECT c_custkey AS id, 'both' AS kind FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey, 'both' FROM orders) UNION ALL (SELECT c_custkey, 'only' FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey, 'only' FROM orders)""")
def company_sets(spark, sf_dir):
    """Intersection and difference of key sets."""
    rich, buyers = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")), orders(spark, sf_dir).select("o_custkey")
    return rich.intersect(buyers).withColumn("kind", F.lit("both")).union(rich.subtract(buyers).withColumn("kind", F.lit("only")))


@query("""
WITH s AS (SELECT p_partkey, string_split(p_type, ' ') AS have FROM part)
SELECT p_partkey, round(CAST(len(list_intersect(['STANDARD', 'POLISHED', 'BRASS'], have)) AS DOUBLE) / 3, 6) AS ratio, list_has_any(have, ['TIN', 'STEEL']) AS touches FROM s""")
def skill_overlap(spark, sf_dir):
    """Which share of the wanted is there."""
    have = F.split("p_type", " ")
    wanted = F.array(*map(F.lit, ("STANDARD", "POLISHED", "BRASS")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(J.overlap_ratio(wanted, have), 6).alias("ratio"), F.arrays_overlap(have, F.array(F.lit("TIN"), F.lit("STEEL"))).alias("touches"))


@query("""SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank FROM orders GROUP BY 1""")
def priority_ranks(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", P.ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]))


@query("""
WITH pairs AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 14 * 86400 * 1000000::BIGINT)
SELECT a, b FROM pairs""")
def duplicate_candidates(spark, sf_dir):
    """Pairs of one company and title, published within two weeks of each other."""
    rows = orders(spark, sf_dir).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    other = rows.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("b_date"))
    return J.within(rows, other, ["o_custkey", "o_orderpriority"], "o_orderdate", "b_date", 14 * 86400).where("o_orderkey < b").select(F.col("o_orderkey").alias("a"), "b")


@query("""
WITH c AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus <> b.o_orderstatus AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 7 * 86400 * 1000000::BIGINT)
SELECT a, min(b) AS b FROM c GROUP BY a HAVING count(DISTINCT b) = 1""")
def strong_matches(spark, sf_dir):
    """The one match of another source within a week; ambiguous ones are none."""
    rows = orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("a_status"), F.col("o_orderdate").alias("a_date"))
    other = rows.select("o_custkey", F.col("a").alias("b"), F.col("a_status").alias("b_status"), F.col("a_date").alias("b_date"))
    return J.exactly_one(J.within(rows, other, ["o_custkey"], "a_date", "b_date", 7 * 86400).where("a_status <> b_status"), "a", "b")


@query("""
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(DISTINCT l_returnflag) AS flags, min(l_returnflag) AS flag FROM lineitem GROUP BY 1)
SELECT l_partkey, sources, CASE WHEN flags > 1 THEN NULL ELSE flag END AS flag, flags > 1 AS conflict FROM g""")
def merged_evidence(spark, sf_dir):
    """What several sources say of one thing: alike is merged, a conflict is nobody's."""
    g = items(spark, sf_dir).groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("sources"), F.count_distinct("l_returnflag").alias("flags"), F.min("l_returnflag").alias("first"))
    return g.select("l_partkey", "sources", F.when(F.col("flags") == 1, F.col("first")).alias("flag"), (F.col("flags") > 1).alias("conflict"))


@query("""
WITH n AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')) AS name, s_nationkey FROM supplier), hits AS (SELECT c_custkey, s_suppkey FROM customer JOIN n ON s_nationkey = c_nationkey AND s_suppkey % 20 = c_custkey % 20)
SELECT c_custkey, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS matched, count(DISTINCT s_suppkey) > 1 AS ambiguous FROM hits GROUP BY 1""")
def company_reconcile(spark, sf_dir):
    """A company's one match by any of its keys; several are an error, not a guess."""
    # suppliers of one nation and remainder match the same customers: their least and greatest tell whether there are several
    keys = table(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 20).alias("k")).agg(F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))
    hits = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 20).alias("k")).join(keys, ["s_nationkey", "k"])
    found = hits.groupBy("c_custkey").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select("c_custkey", F.when(F.col("first") == F.col("last"), F.col("first")).alias("matched"), (F.col("first") != F.col("last")).alias("ambiguous"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, min(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS root FROM orders)
SELECT root AS survivor, count(*) AS merged, min(o_orderdate) AS first_seen FROM s GROUP BY 1""")
def survivors(spark, sf_dir):
    """Each group's oldest row takes over the others."""
    group = ["o_custkey", F.date_trunc("month", "o_orderdate").alias("month")]
    return orders(spark, sf_dir).groupBy(*group).agg(F.min("o_orderkey").alias("survivor"), F.count(F.lit(1)).alias("merged"), F.min("o_orderdate").alias("first_seen")).select("survivor", "merged", "first_seen")


@query(f"""
WITH runs AS (SELECT l_suppkey, max(l_shipdate) AS last_complete FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), seen AS (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2),
o AS (SELECT l_orderkey, bool_and(last_seen < last_complete - INTERVAL 1 DAY) AS closed, count(*) AS occurrences FROM seen JOIN runs USING (l_suppkey) GROUP BY 1)
SELECT l_orderkey, CASE WHEN closed THEN 'CLOSED' ELSE 'ACTIVE' END AS status, occurrences FROM o""")
def closures(spark, sf_dir):
    """A posting is closed once every source that had it has since run in full without it."""
    lines = items(spark, sf_dir)
    runs = lines.where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_complete"))
    seen = lines.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("last_seen"))
    gone = F.col("last_seen") < F.col("last_complete") - F.expr("INTERVAL '1' DAY")
    return seen.join(runs, "l_suppkey").groupBy("l_orderkey").agg(F.bool_and(gone).alias("closed"), F.count(F.lit(1)).alias("occurrences")).select("l_orderkey", F.when(F.col("closed"), "CLOSED").otherwise("ACTIVE").alias("status"), "occurrences")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00001%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderkey AS VARCHAR) LIKE '%77')""")
def company_search(spark, sf_dir):
    """By name or by any alias: names and aliases as one column of strings."""
    customers = table(spark, sf_dir, "customer")
    names = customers.select("c_custkey", F.col("c_name").alias("name")).where(F.col("name").contains("00001"))
    aliases = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("name")).where(F.col("name").endswith("77"))
    return customers.join(names.union(aliases), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -500)""")
def eligible_companies(spark, sf_dir):
    """Active, not covered by either path."""
    covered = orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    boards = table(spark, sf_dir, "supplier").where("s_acctbal < -500").select(F.col("s_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(covered, "c_custkey", "left_anti").join(boards, "c_nationkey", "left_anti").select("c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5""")
def review_candidates(spark, sf_dir):
    """The newest five of each company."""
    return latest_by(orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5).select("o_orderkey", "o_custkey")


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS emitted, count(*) FILTER (WHERE l_returnflag <> 'R') AS correct FROM lineitem GROUP BY 1)
SELECT l_suppkey, emitted, round(CAST(correct AS DOUBLE) / emitted, 6) AS precision, coalesce(emitted >= 20 AND CAST(correct AS DOUBLE) / emitted >= 0.65, false) AS passes FROM s""")
def precision_gates(spark, sf_dir):
    """Rules that may decide: precise enough, on enough cases."""
    counted = items(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("emitted"), F.count_if(F.col("l_returnflag") != "R").alias("correct"))
    return counted.select("l_suppkey", "emitted", A.rate(F.col("correct"), F.col("emitted")).alias("precision"), ((F.col("emitted") >= 20) & (F.col("correct") / F.col("emitted") >= 0.65)).alias("passes"))


@query("""
WITH m AS (SELECT p_brand, avg(p_retailprice) AS acc, min(p_size) AS size, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, size, round(acc, 6) AS acc FROM m WHERE acc >= (SELECT max(acc) FROM m) * 0.98 ORDER BY size, n, p_brand LIMIT 1""")
def constrained_choice(spark, sf_dir):
    """Of those nearly as good as the best, the smallest."""
    models = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("acc"), F.min("p_size").alias("size"), F.count(F.lit(1)).alias("n"))
    best = models.agg(F.max("acc").alias("best"))
    return with_totals(models, best).where(F.col("acc") >= F.col("best") * 0.98).orderBy("size", "n", "p_brand").limit(1).select("p_brand", "size", F.round("acc", 6).alias("acc"))


@query("""
WITH y AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS before, sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS after FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN before IS NULL AND after IS NULL THEN 'missing' WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN abs(after - before) / greatest(abs(before), 1) <= 0.01 THEN 'same' WHEN after > before THEN 'up' ELSE 'down' END AS outcome FROM y""")
def baseline_comparison(spark, sf_dir):
    """Against a baseline: relative, with a tolerance."""
    cut = at(CUTOFF)
    sums = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderdate") < cut, F.col("o_totalprice"))).alias("before"), F.sum(F.when(F.col("o_orderdate") >= cut, F.col("o_totalprice"))).alias("after"))
    return sums.select("o_custkey", compared(F.col("before"), F.col("after")).alias("outcome"))


def compared(before, after, tolerance: float = 0.01):
    delta = F.abs(after - before) / F.greatest(F.abs(before), F.lit(1.0))
    return F.when(before.isNull() & after.isNull(), "missing").when(before.isNull(), "new").when(after.isNull(), "gone").when(delta <= tolerance, "same").when(after > before, "up").otherwise("down")


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority' END) AS missing FROM orders""")
def missing_fields(spark, sf_dir):
    """Names of the fields that are unknown."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "UNKNOWN").otherwise(F.col("o_orderpriority"))
    return orders(spark, sf_dir).select(long("o_orderkey").alias("o_orderkey"), F.array_join(P.unknown_fields({"status": status, "priority": priority}), ",").alias("missing"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE l_quantity IS DISTINCT FROM before) AS changes, count(*) AS versions FROM v GROUP BY 1""")
def field_changes(spark, sf_dir):
    """How many versions changed a value; a cosmetic change is none."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    changed = ~F.col("l_quantity").eqNullSafe(F.col("before"))
    return items(spark, sf_dir).withColumn("before", F.lag("l_quantity").over(by)).groupBy("l_orderkey").agg(F.count_if(changed).alias("changes"), F.count(F.lit(1)).alias("versions"))
