"""Scores and verdicts. Orders stand in for postings: their priority for the level, their line items for skills, their price for pay."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import scoring as S
from sievelake.plans.base import at, query, table

INPUT_SQL = """
WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, datediff('day', o_orderdate, TIMESTAMP '1998-08-02') AS age,
  CASE o_orderstatus WHEN 'O' THEN 'TRUE' WHEN 'P' THEN 'UNKNOWN' ELSE 'FALSE' END AS active, CASE WHEN o_custkey % 7 = 0 THEN 'UNKNOWN' WHEN o_custkey % 7 < 5 THEN 'TRUE' ELSE 'FALSE' END AS mode,
  CASE WHEN o_custkey % 5 = 0 THEN 'NOT_APPLICABLE' WHEN o_custkey % 5 IN (1, 2, 3) THEN 'TRUE' ELSE 'FALSE' END AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE 'TRUE' END AS contract,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SENIOR' WHEN '2-HIGH' THEN 'MID' WHEN '3-MEDIUM' THEN 'JUNIOR' WHEN '5-LOW' THEN 'MANAGER' ELSE 'UNKNOWN' END AS level FROM orders),
sk AS (SELECT l_orderkey, CAST(count(DISTINCT CASE WHEN l_returnflag IN ('N', 'R') THEN l_returnflag END) AS DECIMAL(38, 18)) / 2 AS req FROM lineitem GROUP BY 1),
r AS (SELECT f.*, CASE WHEN mode = 'FALSE' OR country = 'FALSE' OR contract = 'FALSE' THEN 0 WHEN mode IN ('TRUE') OR country = 'TRUE' OR contract = 'TRUE' THEN ((CASE WHEN mode = 'TRUE' THEN 1 ELSE 0.45 END) + (CASE WHEN country = 'TRUE' THEN 1 ELSE 0.45 END) + (CASE WHEN contract = 'TRUE' THEN 1 ELSE 0.45 END)) / 3.0 END AS geo,
  CAST(sk.req AS DOUBLE) AS tech, CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 END AS prio, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0.25 END AS dom,
  CASE level WHEN 'SENIOR' THEN 0.25 WHEN 'MID' THEN 1 WHEN 'JUNIOR' THEN 0.6 WHEN 'MANAGER' THEN 0 END AS sen,
  CASE WHEN contract = 'UNKNOWN' OR o_totalprice < 20000 THEN NULL WHEN o_totalprice >= 60000 THEN 1 ELSE 0 END AS pay, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 < 4 THEN 1 ELSE 0 END AS tz,
  CASE WHEN age < 0 THEN NULL WHEN age <= 3 THEN 1 WHEN age <= 7 THEN 0.9 WHEN age <= 14 THEN 0.75 WHEN age <= 30 THEN 0.5 ELSE 0.25 END AS rec FROM f LEFT JOIN sk ON l_orderkey = o_orderkey),
s AS (SELECT *, round(100 * (0.15 * coalesce(geo, 0.45) + 0.25 * coalesce(tech, 0.45) + 0.10 * coalesce(prio, 0.45) + 0.20 * coalesce(dom, 0.45) + 0.15 * coalesce(sen, 0.45) + 0.05 * coalesce(pay, 0) + 0.05 * coalesce(tz, 0) + 0.05 * coalesce(rec, 0.45))
  / (1 - CASE WHEN pay IS NULL THEN 0.05 ELSE 0 END - CASE WHEN tz IS NULL THEN 0.05 ELSE 0 END), 4) AS score,
  CASE WHEN 'FALSE' IN (active, mode, country, contract) THEN 'INELIGIBLE' WHEN 'UNKNOWN' IN (active, mode, country, contract) THEN 'UNKNOWN' ELSE 'ELIGIBLE' END AS eligibility FROM r)
"""


def measured(spark, sf_dir):
    """Each posting with its four-valued filters and raw factors."""
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("have"))
    rows = table(spark, sf_dir, "orders").join(have, "o_orderkey", "left")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = rows.withColumns(
        {
            "active": F.when(F.col("o_orderstatus") == "O", S.TRUE).when(F.col("o_orderstatus") == "P", S.UNKNOWN).otherwise(S.FALSE),
            "mode": S.known(F.when(cust % 7 != 0, cust % 7 < 5)),
            "country": S.country_filter(F.when(cust % 5 != 0, F.array(F.when((cust % 5).isin(1, 2, 3), "BR").otherwise("US"))), "BR"),
            "contract": S.known(F.when(key % 3 != 0, F.lit(True))),
            "level": F.when(F.col("o_orderpriority") == "1-URGENT", "SENIOR").when(F.col("o_orderpriority") == "2-HIGH", "MID").when(F.col("o_orderpriority") == "3-MEDIUM", "JUNIOR").when(F.col("o_orderpriority") == "5-LOW", "MANAGER").otherwise("UNKNOWN"),
            "age": F.datediff(at("1998-08-02 00:00:00"), F.col("o_orderdate")),
        }
    )
    geo, sure = S.geography(F.col("mode"), F.col("country"), F.col("contract"))
    priority = F.element_at(F.array(F.lit("HIGH"), F.lit("NORMAL"), F.lit("LOW"), F.lit("UNRANKED")), (cust % 4 + 1).cast("int"))
    raw = {
        "GEOGRAPHY_CONTRACT_FIT": geo,
        "TECHNOLOGY_FIT": S.technology(F.when(F.col("have").isNotNull(), F.array(F.lit("N"), F.lit("R"))).otherwise(F.array()), F.array(), F.col("have")),
        "COMPANY_PRIORITY": S.company_priority(priority),
        "DOMAIN_EXPERIENCE": S.domain(F.when(key % 10 == 0, "UNKNOWN").when(key % 2 == 0, "DATA").otherwise("OTHER"), ["DATA"]),
        "SENIORITY_SCOPE": S.seniority_fit(F.col("level"), ["MID"]),
        "CONTRACT_COMPENSATION": S.compensation_fit(F.col("contract"), F.lit(None).cast("double"), F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")), F.lit(True), 60000.0, F.lit(False)),
        "TIMEZONE": F.when(key % 6 == 0, F.lit(None)).when(key % 6 < 4, S.number(1)).otherwise(S.number(0)),
        "RECENCY": S.recency_fit(F.col("age")),
    }
    rows = rows.withColumns({f"raw_{n}": c.cast(S.EXACT) for n, c in raw.items()} | {"sure": sure})
    return rows, {n: F.col(f"raw_{n}") for n in raw}


@query(INPUT_SQL + "SELECT o_orderkey, eligibility, CAST(score AS DOUBLE) AS score FROM s")
def match_scores(spark, sf_dir):
    """Points and eligibility of every posting."""
    rows, raw = measured(spark, sf_dir)
    eligible = S.eligibility([F.col(c) for c in ("active", "mode", "country", "contract")])
    return rows.select("o_orderkey", eligible.alias("eligibility"), S.score(raw).cast("double").alias("score"))


@query(INPUT_SQL + """
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN eligibility = 'INELIGIBLE' THEN 'INELIGIBLE' WHEN contract = 'UNKNOWN' AND o_custkey % 11 = 0 THEN 'REVIEW_REQUIRED' WHEN level <> 'MID' AND level <> 'JUNIOR' THEN CASE WHEN score >= 50 THEN 'WATCHLIST' ELSE 'LOW_MATCH' END
WHEN score >= 80 THEN 'HIGH_PRIORITY' WHEN score >= 65 THEN 'RECOMMENDED' WHEN score >= 50 THEN 'WATCHLIST' ELSE 'LOW_MATCH' END AS verdict FROM s) GROUP BY 1""")
def verdict_counts(spark, sf_dir):
    """How many postings get each verdict."""
    rows, raw = measured(spark, sf_dir)
    eligible = S.eligibility([F.col(c) for c in ("active", "mode", "country", "contract")])
    review = (F.col("contract") == S.UNKNOWN) & (F.col("o_custkey") % 11 == 0)
    found = S.verdict(S.score(raw), eligible, review, F.col("level").isin("SENIOR", "MANAGER"), F.col("level") == "UNKNOWN")
    return rows.select(found.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query()
def score_details(spark, sf_dir):
    """Confidence, the older rules' score and the hash of what went in."""
    rows, raw = measured(spark, sf_dir)
    return rows.select("o_orderkey", S.score(raw).alias("score"), S.score(raw, S.OLD).alias("old_score"), S.confidence(raw, F.col("sure")).alias("confidence"), S.input_hash(*raw.values(), F.lit(S.CURRENT.version)).alias("input_hash"))


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS rn, o_orderstatus = 'O' AS is_current FROM orders)
SELECT o_custkey, o_orderkey, is_current FROM a WHERE rn = 1""")
def current_assessments(spark, sf_dir):
    """Each owner's assessment: the current one first, else the newest."""
    from sievelake.operators.latest import latest_by

    current = S.is_current([(F.col("o_orderstatus"), F.lit("O"))])
    rows = table(spark, sf_dir, "orders").withColumn("is_current", current)
    return latest_by(rows, ["o_custkey"], [~F.col("is_current"), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "is_current")
